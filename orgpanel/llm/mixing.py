"""Mixing sources to target weights: Pfair scheduling, earliest deadline first.

Each source is cut into blocks of ``block_docs`` documents. With integer weights a_i of the sources
still running and D their sum, block j of source i (counted within a period of D slots) is
released at floor(j D / a_i) and due at ceil((j + 1) D / a_i). At each slot the released block
with the earliest deadline goes next, ties to the smaller source name. All windows are met (their fluid schedule
fills every slot), so at every slot each source is less than one block from its target.

All full periods with the same running sources are alike, so one is scheduled for each kind of period, from one count for each source. When a source ends within a
period, that period is scheduled with what is left of it as its weight,
and the others go on with their weights. So there are at most two
kinds for each source, and the plan has at most 2 ``max_sources`` squared entries. Every document gets
exactly one place from 0 without gaps; none is dropped or repeated.

Ranks within a source come from ranges of a hash of the row, of about ``range_docs`` rows each: each (source, range) is numbered on its own
and offset by the counts before it, in two steps of about the square root of their number, so a source that holds a third of all rows is numbered by many
tasks. Only DataFrame and SQL functions run on rows, and only hashes and the columns asked for are shuffled.

Edge cases: sources without a weight, null among them, share ``default`` as weight each,
up to ``max_sources`` distinct names (the documented bound of the counts and the plan on the driver; more
raise an error); a weight below 1 is an error; null and repeated doc_ids are placed like others; rows that are equal in all columns
stand side by side within their source; a further column keeps its value, also one named like those used here;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.storage import materialize


@dataclass(frozen=True)
class MixConfig:
    weights: dict[str, int] = field(default_factory=lambda: {"src0": 6})
    default: int = 2
    block_docs: int = 16
    max_sources: int = 512
    range_docs: int = 100


def plan_periods(blocks: dict[str, int], weight: dict[str, int]) -> list[tuple[int, int, int, dict[str, int]]]:
    """(first period, end period, first slot, blocks of each source in one such period)."""
    out, start, slot = [], 0, 0
    left = {s: n for s, n in blocks.items() if n > 0}
    while left:
        whole = min(left[s] // weight[s] for s in left)
        if whole:
            share = {s: weight[s] for s in left}
            out.append((start, start + whole, slot, share))
            slot += whole * sum(share.values())
            start += whole
            left = {s: n - whole * weight[s] for s, n in left.items() if n > whole * weight[s]}
        if left:
            share = {s: min(weight[s], n) for s, n in left.items()}
            out.append((start, start + 1, slot, share))
            slot, start = slot + sum(share.values()), start + 1
            left = {s: n - share[s] for s, n in left.items() if n > share[s]}
    return out


def schedule(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period, earliest deadline first."""
    total, out = sum(share.values()), {s: [] for s in share}
    later, ready = [(0, s) for s in sorted(share)], []
    for t in range(total):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * total // share[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(t)
        if len(out[s]) < share[s]:
            heapq.heappush(later, (len(out[s]) * total // share[s], s))
    return out


def plan_spans(periods: list[tuple[int, int, int, dict[str, int]]]) -> dict[str, list[dict]]:
    """For each source its runs of blocks: blocks lo to hi (end exclusive), ``a`` in each period of ``total`` slots from ``slot`` on, at ``slots``."""
    spans: dict[str, list[dict]] = {}
    for start, end, slot, share in periods:
        for s, slots in schedule(share).items():
            own = spans.setdefault(s, [])
            lo = own[-1]["hi"] if own else 0
            own.append({"lo": lo, "hi": lo + share[s] * (end - start), "a": share[s], "slot": slot, "total": sum(share.values()), "slots": slots})
    return spans


def slot_of(spans: list[dict], block: int) -> int:
    x = next(x for x in spans if x["lo"] <= block < x["hi"])
    return x["slot"] + (block - x["lo"]) // x["a"] * x["total"] + x["slots"][(block - x["lo"]) % x["a"]]


def source_key(source: Column) -> Column:
    """Names that cannot meet: 'n' for null, 's' before all others."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


SPANS = "array<struct<lo:bigint,hi:bigint,a:bigint,slot:bigint,total:bigint,slots:array<bigint>>>"


def mix_order(docs: DataFrame, cfg: MixConfig = MixConfig(), keep: list[str] | None = None) -> DataFrame:
    """(row, mix_pos, slot): every row of docs, or its columns ``keep``, as a struct with its place in the mixture, from 0, and its block's."""
    if min([cfg.default, *cfg.weights.values()]) < 1 or cfg.block_docs < 1:
        raise ValueError("weights and block_docs are at least 1")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), source_key(docs["source"]).alias("src"), F.xxhash64(whole).alias("h"))
    counts = rows.groupBy("src").agg(F.count("*").alias("n")).limit(cfg.max_sources + 1).collect()
    if len(counts) > cfg.max_sources:
        raise ValueError(f"more than {cfg.max_sources} sources")
    if not counts:
        return rows.select("row", F.lit(0).cast("long").alias("mix_pos"), F.lit(0).cast("long").alias("slot"))
    blocks = {r.src: -(-r.n // cfg.block_docs) for r in counts}
    weight = {s: cfg.weights.get(s[1:], cfg.default) if s[0] == "s" else cfg.default for s in blocks}
    spans = plan_spans(plan_periods(blocks, weight))
    # the last block of a source may be short; all that come later move up
    short = sorted((slot_of(spans[r.src], blocks[r.src] - 1), blocks[r.src] * cfg.block_docs - r.n) for r in counts)

    # at most max_sources rows each; literals, so no row passes through Python
    table = lambda rows, kind: docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))
    ranges = {r.src: max(1, r.n // cfg.range_docs) for r in counts}
    cuts = table([{"src": s, "width": str((1 << 64) // n + 1), "wide": math.isqrt(n) + 1} for s, n in ranges.items()], "src:string,width:decimal(20,0),wide:bigint")
    known = table([{"src": s, "spans": x} for s, x in spans.items()], f"src:string,spans:{SPANS}")
    rows = rows.join(F.broadcast(cuts), "src").withColumn("part", F.expr("cast((cast(h as decimal(20,0)) + 9223372036854775808) div width as bigint)"))
    sizes = rows.groupBy("src", "part").agg(F.count("*").alias("n"), F.first(F.expr("part div wide")).alias("top"))
    sizes, rows = materialize(sizes, "ranges"), rows.drop("width", "wide")
    tops = sizes.groupBy("src", "top").agg(F.sum("n").alias("n"))
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("src", "top", F.coalesce(F.sum("n").over(before("src").orderBy("top")), F.lit(0)).alias("high"))
    sizes = sizes.select("src", "part", "top", F.coalesce(F.sum("n").over(before("src", "top").orderBy("part")), F.lit(0)).alias("low"))
    offsets = sizes.join(tops, ["src", "top"]).select("src", "part", (F.col("high") + F.col("low")).alias("base"))
    number = F.row_number().over(Window.partitionBy("src", "part").orderBy("h", *([F.col("row.doc_id")] if "doc_id" in (keep or docs.columns) else [])))
    ranked = rows.withColumn("k", number).join(offsets, ["src", "part"]).withColumn("rank", F.col("base") + F.col("k") - 1)
    ranked = ranked.withColumn("block", F.expr(f"rank div {cfg.block_docs}"))

    placed = ranked.join(F.broadcast(known), "src").withColumn("sp", F.expr("filter(spans, x -> block >= x.lo and block < x.hi)[0]"))
    slot = F.expr("sp.slot + ((block - sp.lo) div sp.a) * sp.total + sp.slots[cast((block - sp.lo) % sp.a as int)]")
    missing = F.from_json(F.lit(json.dumps([{"at": at, "n": n} for at, n in short if n])), "array<struct<at:bigint,n:bigint>>")
    earlier = F.aggregate(missing, F.lit(0).cast("long"), lambda got, x: got + F.when(x["at"] < F.col("slot"), x["n"]).otherwise(0))
    return placed.withColumn("slot", slot).select("row", (F.col("slot") * cfg.block_docs + F.col("rank") % cfg.block_docs - earlier).alias("mix_pos"), "slot")


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """All rows of docs, laid out in the order of the mixture (part by part, row by row)."""
    dealt = mix_order(docs, cfg).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
