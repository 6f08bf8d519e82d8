"""Approximate nearest neighbours with a forest of random-projection trees.

A node of a tree projects its vectors on a random direction and parts them at the median. Directions come
from a seed; medians are fitted on at most ``sample`` vectors, those with the smallest hash of vec_id (the documented bound), so the forest's size is bounded too. Every vector is then
put into one leaf of each tree. Vectors get one more component that gives all the length of the longest, and queries a zero there, so the largest
inner product is the smallest distance.

All trees of a query share one priority queue: leaves come out in order of the squared distance to the nearest
half-spaces on their path that the query is not in, until they hold ``reach`` of all vectors together. Leaves count as of the whole table, not of the sample.
A half-space farther away than the query's k-th neighbour in the sample holds none of its nearest and is never entered, so vectors
in clusters need few leaves; those without structure read up to ``reach``, which is high for that reason.
The candidates in those leaves are ranked by the exact inner product in double precision. Recall against brute force is measured in the tests.

Equal vectors are one entry of the index with the ids that can be among the nearest of any query (the k + 1 smallest). A
leaf with more entries than ``block`` is dealt in blocks, and blocks go to shards; a task holds one shard and at most about ``slice`` queries, and gives k rows a query.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, neither as query nor as candidate; null ids
likewise; vectors of other lengths than most are left out (length as of the majority, ties to the longer); rows that repeat an id with the same vector
count once; ties go to the smaller vec_id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.storage import materialize


@dataclass(frozen=True)
class AnnConfig:
    k: int = 20
    trees: int = 8
    leaf: int = 128
    sample: int = 16_384
    reach: float = 1.4
    block: int = 4096
    shard: int = 32_768
    slice: int = 4096
    seed: int = 7


def lifted(vectors: np.ndarray, longest: float | None = None) -> np.ndarray:
    """With one more component: for entries what they lack to the squared length ``longest``, for queries 0."""
    more = np.zeros(len(vectors)) if longest is None else np.sqrt(np.maximum(0, longest - (vectors * vectors).sum(axis=1)))
    return np.column_stack([vectors, more]).astype(np.float32)


class Forest:
    """Directions and medians of all trees, level by level."""

    def __init__(self, sample: np.ndarray, rows: int, cfg: AnnConfig):
        self.depth = max(0, int(np.ceil(np.log2(max(rows, 1) / cfg.leaf))))
        self.depth = min(self.depth, max(0, int(np.log2(max(len(sample), 1) / 8))))
        rng = np.random.default_rng(cfg.seed)
        nodes = (1 << self.depth) - 1
        self.planes = rng.normal(size=(cfg.trees, nodes, sample.shape[1])).astype(np.float32)
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((cfg.trees, nodes), np.float32)
        for t in range(cfg.trees):
            todo = [(0, np.arange(len(sample)))]
            while todo:
                node, own = todo.pop()
                if node >= nodes:
                    continue
                side = sample[own] @ self.planes[t, node]
                self.cuts[t, node] = np.median(side) if len(own) else 0
                high = side >= self.cuts[t, node]
                todo += [(2 * node + 1, own[~high]), (2 * node + 2, own[high])]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(self.planes), len(vectors)), np.int64)
        for t in range(len(self.planes)):
            for _ in range(self.depth):
                at = out[t]
                out[t] = 2 * at + 1 + (np.einsum("ij,ij->i", vectors, self.planes[t, at]) >= self.cuts[t, at])
        return out - ((1 << self.depth) - 1)

    def visit(self, q: np.ndarray, counts: np.ndarray, want: float, radius: float = np.inf) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold ``want`` vectors or all others lie beyond ``radius``."""
        if not self.depth:
            return [(0, 0)]
        margin = self.planes @ q - self.cuts
        nodes, got, out = (1 << self.depth) - 1, 0, []
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue and got < want:
            cost, t, node = heapq.heappop(queue)
            while node < nodes:
                m = float(margin[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                if abs(m) <= radius:
                    heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            got += counts[t, node - nodes]
            out.append((t, node - nodes))
        return out


def radii(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each (lifted) query an upper bound of the distance of its k-th neighbour: that of the (k + 1)-th in the sample, as the query may be in it."""
    if len(sample) <= k:
        return np.full(len(queries), np.inf)
    out, size = np.empty(len(queries)), (sample * sample).sum(axis=1)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        far = (q * q).sum(axis=1)[:, None] + size[None, :] - 2 * q @ sample.T
        out[at : at + 256] = np.partition(far, k, axis=1)[:, k]
    return np.sqrt(np.maximum(out, 0)) * 1.001 + 1e-3


def nearest(vectors: DataFrame, query: str, cfg: AnnConfig = AnnConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``query`` (a condition on vec_id) picks."""
    spark = vectors.sparkSession
    fine = "size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x != 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(f"vec_id is not null and v is not null and {fine}")
    rows = materialize(rows.distinct(), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("longest")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == lengths[0].d)
    # one entry for equal vectors: only the smallest ids can be among the nearest k of a query
    tops = rows.groupBy("v").agg(F.min("vec_id").alias("entry"), F.count("*").alias("c"))
    several = tops.where("c > 1").select("v", "entry")
    number = F.row_number().over(Window.partitionBy("entry", "salt").orderBy("vec_id"))
    salted = rows.join(several, "v").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).select("entry", "salt", "vec_id").withColumn("r", number).where(F.col("r") <= cfg.k + 1)
    ids = salted.groupBy("entry").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, cfg.k + 1).alias("ids"))
    entries = materialize(tops.join(ids, "entry", "left").select("entry", "v", F.coalesce("ids", F.array("entry")).alias("ids")), "entries")

    count = entries.count()
    drawn = entries.orderBy(F.xxhash64("entry"), "entry").limit(cfg.sample).select("entry", "v").collect()
    longest = lengths[0].longest
    sampled = lifted(np.array([r.v for r in drawn]), longest)
    forest = Forest(sampled, count, cfg)
    shared, known = spark.sparkContext.broadcast(forest), spark.sparkContext.broadcast(sampled)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                leaf = shared.value.leaves(lifted(np.array(f.v.tolist()), longest))
                for t in range(len(leaf)):
                    yield f.assign(tree=t, leaf=leaf[t])

    placed = entries.mapInPandas(place, "entry long, v array<double>, ids array<long>, tree int, leaf long")
    placed = materialize(placed, "leaves")
    sizes = placed.groupBy("tree", "leaf").agg(F.count("*").alias("c")).collect()  # bounded by the forest
    counts = np.zeros((cfg.trees, 1 << forest.depth), np.int64)
    for r in sizes:
        counts[r.tree, r.leaf] = r.c
    counted = spark.sparkContext.broadcast(counts)

    # a leaf's block is known by one number; blocks are dealt in shards of about ``shard`` entries. The number is mixed first: most
    # leaves may hold few blocks of those counted for the largest, and plain remainders would then meet in some shards only
    leaves, blocks = 1 << forest.depth, int(-(-counts.max() // cfg.block))
    shards = max(1, -(-int(counts.sum()) // cfg.shard))
    mixed = f"code % 1073741824 * 2654435761 % 4294967296 div 1024 % {shards}"
    asked = rows.where(query)
    slices = max(1, -(-asked.count() // cfg.slice))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = counted.value
        for f in frames:
            if not len(f):
                continue
            points = lifted(np.array(f.v.tolist()))
            for q, v, point, radius in zip(f.vec_id, f.v, points, radii(points, known.value, cfg.k)):
                found = shared.value.visit(point, n, cfg.reach * count, radius)
                codes = np.array([(t * leaves + leaf) * blocks + b for t, leaf in found for b in range(-(-int(n[t, leaf]) // cfg.block))], np.int64)
                at = codes % 1073741824 * 2654435761 % 4294967296 // 1024 % shards
                own = [(int(k), codes[at == k]) for k in np.unique(at)]
                yield pd.DataFrame({"shard": [k for k, _ in own], "slice": q * 2654435761 % 4294967296 // 1024 % slices, "query_id": q, "v": [v] * len(own), "codes": [c for _, c in own]})

    probes = asked.mapInPandas(search, "shard long, slice long, query_id long, v array<double>, codes array<long>")
    per_leaf = placed.groupBy("tree", "leaf").agg(F.count("*").alias("c"))
    part = f"pmod(xxhash64(entry), cast(ceil(c / {cfg.block}) as bigint))"
    index = placed.join(F.broadcast(per_leaf), ["tree", "leaf"]).withColumn("code", F.expr(f"(tree * {leaves}L + leaf) * {blocks}L + {part}"))
    index = index.select(F.expr(mixed).alias("shard"), F.explode(F.expr(f"sequence(0L, {slices - 1}L)")).alias("slice"), "code", "v", "ids")

    def rerank(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query among the shard's candidates, leaf by leaf: one product for all queries that visit it."""
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x = x.sort_values("code", kind="stable")
        base, ids, vectors, asked = np.array(x.v.tolist()), x.ids.tolist(), np.array(q.v.tolist()), q.query_id.to_numpy(np.int64)
        entry = np.array([i[0] for i in ids], np.int64)
        codes, first = np.unique(x.code.to_numpy(), return_index=True)
        last = np.append(first[1:], len(x))
        visits = np.concatenate(q.codes.tolist())
        by = np.repeat(np.arange(len(q)), q.codes.map(len))
        order = np.argsort(visits, kind="stable")
        visits, by = visits[order], by[order]
        lo, hi = np.searchsorted(visits, codes), np.searchsorted(visits, codes, side="right")
        keep = cfg.k + 1  # the query itself may be among them
        floor = np.full(len(q), -np.inf)
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best entries of each query among those held; what is worse than all of them need not be held again."""
            who, at, score = (np.concatenate(c) for c in zip(*held))
            o = np.lexsort((entry[at], who))
            new = np.ones(len(o), bool)
            new[1:] = (who[o][1:] != who[o][:-1]) | (entry[at[o]][1:] != entry[at[o]][:-1])
            who, at, score = who[o[new]], at[o[new]], score[o[new]]
            o = np.lexsort((entry[at], -score, who))
            who, at, score = who[o], at[o], score[o]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            full = place == keep - 1
            floor[who[full]] = score[full] - 1e-9
            return who[place < keep], at[place < keep], score[place < keep]

        size = 0
        for a, z, f, e in zip(lo, hi, first, last):
            for at in range(a, z, 1024):
                who = by[at : min(z, at + 1024)]
                s = vectors[who] @ base[f:e].T
                i, j = np.nonzero(s >= floor[who][:, None])
                held.append((who[i], j + f, s[i, j]))
                size += len(i)
                if size > 1 << 20:
                    held = [best()]
                    size = 0
        who, at, score = best()
        many = np.array([len(i) for i in ids])[at] if len(at) else np.empty(0, np.int64)
        made = pd.DataFrame({"query_id": np.repeat(asked[who], many), "vec_id": np.concatenate([ids[i] for i in at] or [[]]).astype(np.int64), "score": np.repeat(score, many)})
        made = made[made.query_id != made.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return made.groupby("query_id").head(cfg.k)

    near = probes.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
