"""Benchmark decontamination by spaced-seed hashing.

Texts become words (letters and digits, lower-cased). A mask such as ``110111`` slides over the
words and hashes those under its ones; the ignored places may differ between a passage and its copy. Hashes of the test
items are joined with those of the training texts; a hit fixes the shift between the two. At every
shift found, all words of the item are held against the text, place by place, and the best stretch of
``window`` words (the whole item, if shorter) counts: a leak has at least ``percent`` equal words in it. Items of some lengths up to ``window``
have further masks of their own, so that every choice of replaced words that ``percent`` allows leaves a hit; texts are hashed under these only if
the benchmark has items of such lengths.

The hashes of the items are broadcast only up to ``broadcast_seeds`` rows (counted first); beyond that the same join
shuffles both sides. Training hashes never carry the text; texts of documents with hits are fetched once for the check. Only
DataFrame and SQL functions are used.

Edge cases: null and empty texts and items have no words and never match; items of
a few words are found within longer texts too; repeated rows of
a doc_id or an item_id count once, and their different texts are all tried; null ids are left out of the pairs, but rows without a doc_id are
judged by their text when leaks are removed; other columns are
ignored; an empty table on either side gives no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.llm.common import small_side
from orgpanel.storage import materialize


@dataclass(frozen=True)
class DecontamConfig:
    masks: tuple[str, ...] = ("110111", "1011011")
    window: int = 13
    percent: int = 80
    broadcast_seeds: int = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hit(mask: str, n: int, changed: tuple[int, ...]) -> bool:
    """Whether the mask has a place in n words at which none of its ones is changed."""
    return any(all(p + k not in changed for k, c in enumerate(mask) if c == "1") for p in range(n - len(mask) + 1))


@cache
def short_masks(cfg: DecontamConfig) -> dict[int, tuple[str, ...]]:
    """For each length up to ``window`` the masks that it needs besides ``cfg.masks``; items of more words are as those of ``window``.

    Every choice of the most replaced words allowed then leaves a mask whole, and so does every choice of fewer.
    """
    out = {}
    for n in range(1, cfg.window + 1):
        changes = combinations(range(n), n - -(-cfg.percent * n // 100))
        missed, added = [c for c in changes if not any(_hit(m, n, c) for m in cfg.masks)], []
        while missed:
            masks = sorted({"".join("0" if k in c else "1" for k in range(n)).strip("0") for c in missed} - {""})
            if not masks:
                break
            added.append(max(masks, key=lambda m: sum(_hit(m, n, c) for c in missed)))
            missed = [c for c in missed if not _hit(added[-1], n, c)]
        if added:
            out[n] = tuple(added)
    return out


def _seed_array(masks: list[tuple[int, str, str]]) -> str:
    """All seeds of the array ``w``: for each (number, mask, condition) and place, the hash of the words under the ones."""
    parts = []
    for m, mask, when in masks:
        under = ", ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")
        parts.append(f"if({when}size(w) >= {len(mask)}, transform(sequence(0, size(w) - {len(mask)}), i -> named_struct('at', i, 'h', xxhash64({m}, {under}))), array())")
    return f"concat({', '.join(parts)})"


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """(doc_id, item_id, matched, compared): each pair that leaks, with the equal words of its best stretch."""
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    longest = F.max(F.size("w")).over(Window.partitionBy("item_id"))
    items = materialize(items.withColumn("n", longest), "items")
    # at most ``window`` rows
    lengths = {r.k for r in items.select(F.expr(f"least(size(w), {cfg.window})").alias("k")).distinct().collect()}
    short = {n: m for n, m in short_masks(cfg).items() if n in lengths}
    own = {mask: sorted(n for n in short if mask in short[n]) for mask in sorted({m for ms in short.values() for m in ms})}
    base = [(m, mask, "") for m, mask in enumerate(cfg.masks)]
    more = [(len(base) + m, mask, f"least(size(w), {cfg.window}) in ({', '.join(map(str, ns))}) and ") for m, (mask, ns) in enumerate(own.items())]
    item_seeds = items.select("item_id", "n", F.explode(F.expr(_seed_array(base + more))).alias("s")).select("item_id", "n", "s.h", F.col("s.at").alias("item_at"))
    if item_seeds.count() <= cfg.broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    texts = docs.where("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("w"))
    seeds = texts.select("doc_id", F.explode(F.expr(_seed_array(base + [(m, mask, "") for m, mask, _ in more]))).alias("s")).select("doc_id", "s.h", F.col("s.at").alias("doc_at"))
    hits = seeds.join(item_seeds, "h").select("doc_id", "item_id", "n", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "hits")

    by_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "n", "shift")).alias("hits"))
    hit_ids = materialize(hits.select("doc_id").distinct(), "hit_ids", small=True)
    source = docs.where("doc_id is not null").select("doc_id", "text").join(small_side(hit_ids), "doc_id", "left_semi")
    found = by_doc.join(source, "doc_id").select("doc_id", "hits", words_of(F.col("text")).alias("w"))
    # only the stretch of the text beside the item goes on with each hit
    tried = found.select("doc_id", F.explode("hits").alias("hit"), "w")
    beside = "slice(w, greatest(hit.shift, 0) + 1, hit.n + least(hit.shift, 0))"
    tried = tried.select("doc_id", "hit.item_id", F.expr("least(hit.shift, 0)").alias("skip"), F.expr(beside).alias("part"))
    flags = "transform(iw, (x, k) -> if(k + skip between 0 and size(part) - 1 and part[greatest(least(k + skip, size(part) - 1), 0)] = x, 1, 0))"
    held = tried.join(items.select("item_id", F.col("w").alias("iw")), "item_id").select("doc_id", "item_id", F.expr(flags).alias("f"))
    width = f"least(size(f), {cfg.window})"
    best = f"array_max(transform(sequence(0, size(f) - {width}), i -> aggregate(slice(f, i + 1, {width}), 0, (a, x) -> a + x)))"
    close = held.select("doc_id", "item_id", F.expr(best).alias("matched"), F.expr(width).alias("compared"))
    pairs = close.where(f"100 * matched >= {cfg.percent} * compared").groupBy("doc_id", "item_id")
    return pairs.agg(F.max(F.struct("matched", "compared")).alias("m")).select("doc_id", "item_id", "m.matched", "m.compared")


def clean_documents(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """The rows of docs without a leak, all columns kept. Each goes by its own text, with or without a doc_id."""
    key = F.xxhash64(docs["text"])
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, cfg).select(F.col("doc_id").alias("leaked")).distinct()
    found = small_side(materialize(found, "leaks", small=True))
    return docs.join(found, key == found["leaked"], "left_anti")


def leak_sql(cfg: DecontamConfig = DecontamConfig()) -> str:
    """The pairs of ``leaks`` in DuckDB's SQL; the words under a mask stand for their hash."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    shortest = min(map(len, cfg.masks))

    def seeds(table: str, key: str) -> str:
        parts = []
        for m, mask in enumerate(cfg.masks):
            under = ", ".join(f"w[place + {k + 1}]" for k, c in enumerate(mask) if c == "1")
            places = f"SELECT {key}, w, unnest(range(len(w) - {len(mask) - 1})) AS place FROM {table} WHERE len(w) >= {len(mask)}"
            parts.append(f"SELECT {key}, place, concat_ws(' ', '{m}', {under}) AS h FROM ({places})")
        return " UNION ALL ".join(parts)

    return f"""
        WITH items AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
        texts AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
        item_seeds AS ({seeds("items", "item_id")}),
        text_seeds AS ({seeds("texts", "doc_id")}),
        hits AS (SELECT DISTINCT t.doc_id, s.item_id, t.place - s.place AS shift FROM text_seeds t JOIN item_seeds s USING (h)),
        held AS (
            SELECT row_number() OVER () AS n, doc_id, item_id, shift, x.w AS w, i.w AS iw, least(len(i.w), {cfg.window}) AS width
            FROM hits JOIN texts x USING (doc_id) JOIN items i USING (item_id)),
        flags AS (SELECT n, doc_id, item_id, width, k, CASE WHEN k + shift >= 0 AND w[k + shift + 1] = iw[k + 1] THEN 1 ELSE 0 END AS f
            FROM (SELECT *, unnest(range(len(iw))) AS k FROM held)),
        sums AS (SELECT doc_id, item_id, width, k, sum(f) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN {cfg.window - 1} PRECEDING AND CURRENT ROW) AS matched FROM flags),
        close AS (SELECT doc_id, item_id, matched, width AS compared FROM sums
            WHERE k >= width - 1 AND 100 * matched >= {cfg.percent} * width AND width >= {shortest}),
        same AS (SELECT doc_id, item_id, len(i.w) AS matched, len(i.w) AS compared FROM texts x JOIN items i ON x.w = i.w WHERE len(i.w) BETWEEN 1 AND {shortest - 1}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, compared DESC) AS r
            FROM (SELECT * FROM close UNION ALL SELECT * FROM same))
        SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(compared AS INTEGER) AS compared FROM ranked WHERE r = 1"""
