"""Ownership transfers: last version of each record, transfers between different parties, counts by patent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpanel.functions.names import INDIVIDUAL, OTHER, convey_type, org_type, same_entity
from orgpanel.functions.places import country_code, state_code
from orgpanel.operators.relational import keep_last


def real_transfers(records: DataFrame) -> DataFrame:
    """Records between organisations that convey ownership."""
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.where((org_type(name("assignor")) != INDIVIDUAL) & (org_type(name("assignee")) != INDIVIDUAL) & (convey_type(name("conveyance")) != OTHER))


def prune_transfers(records: DataFrame, order: list[Column | str]) -> DataFrame:
    """Transfers in use: the last record of each assignid with a patent and a date, between different entities."""
    last = keep_last(records, ["assignid"], order).dropna(subset=["patnum", "execdate"])
    coded = last.withColumn("assignee_state", state_code(F.col("assignee_state"))).withColumn("assignee_country", country_code(F.col("assignee_country")))
    return coded.where(~same_entity(F.col("assignor"), F.col("assignee")))


def transfer_stats(transfers: DataFrame) -> DataFrame:
    """patnum, first_trans, n_trans."""
    kept = transfers.where("patnum is not null")
    return kept.groupBy("patnum").agg(F.min("execdate").alias("first_trans"), F.count("*").alias("n_trans"))
