"""Fixed-width maintenance events and the accounts CSV: native scans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpanel.functions.ids import industry_code, prune_number
from orgpanel.operators.maintenance import maintenance_rollup
from orgpanel.operators.relational import dense_id
from orgpanel.storage import list_files

# Places of the fields in a line, end exclusive. Codes have four or five characters.
FIELDS = {"patnum": (0, 13), "is_small": (23, 24), "event_code": (52, 57)}
# Columns of the accounts file.
ACCOUNTS = {
    "row": "row", "gvkey": "gvkey", "fyear": "year", "conm": "name", "AT": "assets", "CAPX": "capx", "CH": "cash", "COGS": "cogs", "CSHO": "shares", "DP": "deprec", "EBITDA": "income", "EMP": "employ",
    "INTAN": "intan", "LT": "debt", "REVT": "revenue", "SALE": "sales", "XRD": "rnd", "XSGA": "fcost", "prcc_f": "price", "NAICS": "naics", "SIC": "sic",
}


def latest(paths: list[str]) -> str:
    """The file with the largest date after its last underscore."""
    return max(paths, key=lambda p: int(re.search(r"_(\d+)\.[^.]*$", p)[1]))


def newest_snapshot(spark: SparkSession, path: str) -> str:
    """The newest MaintFeeEvents file of a folder; any other path, and a folder without such files, as it is."""
    dated = [f for f in list_files(spark, path, ("MaintFeeEvents_*.*",)) if re.search(r"MaintFeeEvents_\d+\.(?!zip$)[^./]*$", f)]
    return latest(dated) if dated else path


def maintenance_events(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    cut = {n: F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")) for n, (a, b) in FIELDS.items()}
    return lines.select(prune_number(F.lower(cut["patnum"]), 13).alias("patnum"), cut["is_small"].alias("is_small"), cut["event_code"].alias("event_code"))


def maintenance_table(spark: SparkSession, path: str) -> DataFrame:
    return maintenance_rollup(maintenance_events(spark, path))


def accounts_table(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path).select(*ACCOUNTS).withColumnsRenamed(ACCOUNTS)
    whole = ("gvkey", "year", "naics", "sic")
    kept = raw.select("row", F.lower("name").alias("name"), *[F.col(c).try_cast("double").try_cast("long").alias(c) for c in whole], *[F.col(c).try_cast("double").alias(c) for c in ACCOUNTS.values() if c not in ("row", "name", *whole)])
    kept = kept.withColumn("mktval", F.col("shares") * F.col("price")).drop("shares", "price").dropna(subset=["gvkey", "year", "name"])
    kept = kept.withColumn("naics", industry_code(F.col("naics"))).withColumn("sic", industry_code(F.col("sic")))
    return dense_id(kept.withColumn("row", F.col("row").try_cast("long")), ["row", "gvkey", "year", "name"], "compid").drop("row")
