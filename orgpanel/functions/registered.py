"""The string functions by name, for SQL: temporary functions whose bodies Catalyst inlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from orgpanel.functions import ids, names, places, similarity

#: name -> (builder, parameters)
FUNCTIONS: dict[str, tuple[Callable[..., Column], dict[str, str]]] = {
    "prune_number": (ids.prune_number, {"raw": "string"}),
    "pad_class": (ids.pad_class, {"code": "string"}),
    "industry_code": (ids.industry_code, {"code": "bigint"}),
    "fee_lag": (ids.fee_lag, {"code": "string"}),
    "year_of": (ids.year_of, {"day": "string"}),
    "weak_name": (names.weak_name, {"name": "string"}),
    "strong_name": (names.strong_name, {"name": "string"}),
    "org_type": (names.org_type, {"name": "string"}),
    "convey_type": (names.convey_type, {"conveyance": "string"}),
    "same_entity": (names.same_entity, {"assignor": "string", "assignee": "string"}),
    "state_code": (places.state_code, {"name": "string"}),
    "country_code": (places.country_code, {"name": "string"}),
    "edit_similarity": (similarity.edit_similarity, {"a": "string", "b": "string"}),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names. The SimHash is an Arrow UDF, the others are expressions."""
    for name, (build, parameters) in FUNCTIONS.items():
        typed = spark.range(1).select(*[F.lit(None).cast(t).alias(p) for p, t in parameters.items()])
        made = typed.select(build(*[F.col(p) for p in parameters]).alias("made"))
        body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
        kind = made.schema[0].dataType.simpleString()
        given = ", ".join(f"{p} {t}" for p, t in parameters.items())
        spark.sql(f"create or replace temporary function {name}({given}) returns {kind} return {body}")
    spark.udf.register("simhash", similarity.simhash)
    return [*FUNCTIONS, "simhash"]
