"""Citation counts of each patent, with those within one organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpanel.operators.relational import prefixed


def citation_stats(cites: DataFrame, firms: DataFrame) -> DataFrame:
    """patnum, n_cited (made), n_citing (received), n_self_cited, n_self_citing from (src, dst) and (patnum, firm_num).

    Both ends are stacked, so one aggregation on patnum serves all four counts. Null keys count for nobody;
    two unknown firms are not the same.
    """
    ends = cites.join(prefixed(firms, "citer_"), F.col("src") == F.col("citer_patnum"), "left")
    ends = ends.join(prefixed(firms, "citee_"), F.col("dst") == F.col("citee_patnum"), "left")
    own = F.coalesce(F.col("citer_firm_num") == F.col("citee_firm_num"), F.lit(False)).cast("long")
    ends = ends.select(F.explode(F.array(F.struct(F.col("src").alias("patnum"), F.lit(1).alias("made"), own.alias("own")), F.struct(F.col("dst").alias("patnum"), F.lit(0).alias("made"), own.alias("own")))).alias("e")).select("e.*")
    made = F.col("made") == 1
    return ends.where("patnum is not null").groupBy("patnum").agg(
        F.count_if(made).alias("n_cited"),
        F.count_if(~made).alias("n_citing"),
        F.sum(F.when(made, F.col("own")).otherwise(0)).alias("n_self_cited"),
        F.sum(F.when(made, 0).otherwise(F.col("own"))).alias("n_self_citing"),
    )
