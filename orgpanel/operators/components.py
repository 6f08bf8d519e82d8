"""Connected components by alternating large-star and small-star contraction.

Rounds grow with the logarithm of the longest path. Each is one partial
aggregation and one equi-join on a node id; AQE splits the join at a node with very many
links. Every round is written to the shared folder, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpanel.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id that occurs in a link; component is the smallest id reached.

    Null ends and self-links are ignored as links (a node with nothing but a self-link is its
    own component); repeated links and either direction are the same; no rows give no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    alone = pairs.where("u = v").select(F.col("u").alias("id")).distinct()
    current = materialize(_small_star(pairs.where("u != v")), "cc", small=True)
    mark = _mark(current)
    while mark[0]:
        after = materialize(_small_star(_large_star(current)), "cc", small=True)
        discard(current)
        current, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    lone = alone.join(stars.select("id"), "id", "left_anti").join(roots.select("id"), "id", "left_anti")
    return stars.unionAll(roots).unionAll(lone.select("id", F.col("id").alias("component")))
