"""Small relational building blocks that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def keep_last(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by the order; give an order that leaves no ties."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each value of key with the position where it is seen first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias(position))


def dense_id(df: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """Numbers from 0 without gaps in the given order.

    Ranges of the order are numbered on their own and offset by the counts before them, so
    no task holds all rows; only one count for each range meets in one place.
    """
    from orgpanel.storage import materialize

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_m0"))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("_p", "_m0", F.coalesce(before, F.lit(0)).alias("_b"))
    return ranged.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_m") - F.col("_m0")).drop("_p", "_m", "_b", "_m0")


def group_mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group and its count, ties to the smallest value."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("mode")))
    return counts.groupBy(group).agg(best.alias("m")).select(group, F.col("m.mode").alias("mode"), (-F.col("m.less")).alias("n"))


def full_align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer alignment of frames that have one row a key: stacked and aggregated in one shuffle, null stays null."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    stacked = stacked.dropna(subset=keys)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])
