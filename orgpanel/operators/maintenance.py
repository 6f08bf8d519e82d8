"""Maintenance fees by patent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpanel.functions.ids import fee_lag


def maintenance_rollup(events: DataFrame, lag=fee_lag) -> DataFrame:
    """patnum, last_maint, ever_large from (patnum, is_small Y/N, event_code); other events drop out."""
    paid = events.select("patnum", (F.col("is_small") == "Y").alias("small"), lag(F.col("event_code")).alias("lag")).dropna()
    return paid.groupBy("patnum").agg(F.max("lag").alias("last_maint"), (~F.bool_and("small")).alias("ever_large"))
