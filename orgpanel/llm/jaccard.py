"""N-gram Jaccard join by prefix trees.

Every text becomes the set of its word n-grams (64-bit hashes). One order holds for all sets:
n-grams in rarely filled buckets of a fixed-size count sketch first, ties by hash. Any fixed
order gives exact results; this one keeps passages that many texts share out of the prefixes.

1. Every row gets a number. Rows with equal sets form a class; the row with the smallest number stands for it.
2. Two sets that reach the threshold share an n-gram within the first ``n - ceil(t n) + 1``
   of each (the prefix). Prefix entries are dealt by n-gram. In lists of up to ``short``
   members the shared entries of each pair are counted, and the pair is kept only if its first shared place, what lies beyond the prefixes and
   its entries in longer lists could still lift it to the threshold. In longer lists an entry has a range of sizes that a partner
   may have if this n-gram is the first they share; a set is linked to the hub of such partners, the first of those of its size class that can meet larger sets.
   So a passage in the late places of many sets links none of them. All this only tells which sets may belong together (the *clusters*).
3. The ordered sets of clusters are written once. A cluster of more than ``block`` sets or ``block_grams`` n-grams is dealt in blocks by size class
   and hash, and its ``hubs`` sets with the most candidate links stand in every block. In a block the sets go into a
   compressed trie. A set is matched by one walk that shares the overlap of common
   paths and leaves a subtree when the sizes or remaining lengths below it rule the
   threshold out. Once the sets of a block are linked into groups, only sets outside
   the largest group walk, so copies in any number cost about one walk together with their trie.
4. In clusters of several blocks, the sets outside the cluster's largest group then walk the
   tries of all blocks of neighbouring size classes, one by one and ``slice`` of them to a task. Any link between two groups has an end outside the largest, so none is lost.
5. Connected components over the links, carried over to all rows of the classes.

Edge cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; with fewer than ``n`` words the whole sequence is the one n-gram; a null doc_id is in no
link, and its row shows the smallest doc_id with an equal set, else null; rows that repeat a doc_id are rows of their own, each
with the links of its own text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.llm.common import small_side
from orgpanel.operators.components import connected_components
from orgpanel.storage import materialize, temporary

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardConfig:
    n: int = 4
    percent: int = 85
    sketch_bits: int = 21
    short: int = 48
    block: int = 512
    block_grams: int = 1 << 20
    hubs: int = 8
    slice: int = 4096


def shingler(n: int):
    """text -> sorted distinct 64-bit hashes of its word n-grams (ASCII letters lower-cased)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(digest, words), np.uint64, len(words))
        width = min(n, len(w))
        h = w[: len(w) - width + 1] + np.uint64(width)
        for k in range(1, width):
            h = (h ^ (h >> np.uint64(31))) * MIX + w[k : len(w) - width + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * MIX
        return np.unique(h ^ (h >> np.uint64(32)))

    return shingles


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def in_order(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order, rare first."""
    return h[np.lexsort((h, sketch[h & np.uint64(len(sketch) - 1)]))]


def count_sketch(docs: DataFrame, cfg: JaccardConfig) -> np.ndarray:
    """How often each bucket of n-gram hashes is filled, over all texts; 4 bytes x 2**sketch_bits at any input size."""
    size, part = 1 << cfg.sketch_bits, 1 << min(15, cfg.sketch_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = shingler(cfg.n), np.zeros(size, np.uint32)
        for b in batches:
            for text in b.column("text"):
                total[shingles(text.as_py()) & np.uint64(size - 1)] += 1
        for k in range(size // part):
            piece = total[k * part : (k + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "c": [piece.astype("<u4").tobytes()]})

    def add(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(part, np.uint32)
        for x in pieces:
            for c in x.c:
                total += np.frombuffer(c, "<u4")
        yield pd.DataFrame({"k": [key[0]], "c": [total.tobytes()]})

    got = docs.select("text").mapInArrow(count, "k int, c binary").groupBy("k").applyInPandas(add, "k int, c binary").collect()
    out = np.zeros(size, np.uint32)
    for row in got:
        out[row.k * part : (row.k + 1) * part] = np.frombuffer(bytes(row.c), "<u4")
    return out


def prefixes(docs: DataFrame, sketch, cfg: JaccardConfig) -> DataFrame:
    """doc_id, mark, n, digest of the set, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, order = shingler(cfg.n), sketch.value
        for b in batches:
            sizes, digests, heads = [], [], []
            for text in b.column("text"):
                h = shingles(text.as_py())
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                heads.append(in_order(h, order)[: prefix_length(len(h), cfg.percent)] if len(h) else h)
            at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.empty(0, np.uint64)
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), column], ["doc_id", "mark", "n", "digest", "head"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, digest binary, head array<long>")


def gram_sets(rows: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """The rows with ``grams``, the set of each text as sorted 64-bit numbers, in place of ``text``."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(cfg.n)
        for b in batches:
            made = pa.array([shingles(t.as_py()).tobytes() for t in b.column(at)], pa.binary())
            yield b.remove_column(at).append_column("grams", made)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kept, "grams binary"]))


class Node:
    __slots__ = ("children", "docs", "high", "low", "seg")

    def __init__(self, seg: np.ndarray, low: int, high: int):
        self.seg, self.low, self.high, self.children, self.docs = seg, low, high, [], []


def build_trie(sets: list[np.ndarray], index: list[int]) -> Node:
    """A compressed trie of the ordered sets; a node knows the sizes of the sets below it."""
    rows = sorted(index, key=lambda i: sets[i].astype(">i4").tobytes())
    top = Node(np.empty(0, np.int32), 1 << 60, 0)
    todo = [(top, rows, 0)]
    while todo:
        node, below, depth = todo.pop()
        sizes = [len(sets[i]) for i in below]
        node.low, node.high = min(sizes, default=0), max(sizes, default=0)
        first = 0
        while first < len(below) and len(sets[below[first]]) == depth:
            node.docs.append(below[first])
            first += 1
        while first < len(below):
            token, last = sets[below[first]][depth], first + 1
            while last < len(below) and sets[below[last]][depth] == token:
                last += 1
            a, z = sets[below[first]], sets[below[last - 1]]
            m = min(len(a), len(z))
            differ = np.flatnonzero(a[depth:m] != z[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            child = Node(a[depth:end], 0, 0)
            node.children.append(child)
            todo.append((child, below[first:last], end))
            first = last
    return top


def walk(trie: Node, n: int, mask: np.ndarray, percent: int) -> Iterator[int]:
    """Rows of the trie whose sets reach the threshold with the set of n tokens marked in mask."""
    todo = [(trie, 0, 0)]
    while todo:
        node, shared, depth = todo.pop()
        if len(node.seg):
            shared += int(np.count_nonzero(mask[node.seg]))
            depth += len(node.seg)
        if 100 * node.high < percent * n or percent * node.low > 100 * n:
            continue
        most = shared + min(n - shared, node.high - depth)
        if most * (100 + percent) < percent * (n + node.low):
            continue
        if node.docs and shared * (100 + percent) >= percent * (n + depth):
            yield from node.docs
        todo.extend((c, shared, depth) for c in node.children)


class Block:
    """The trie of some sets, frequent n-grams first so that common passages are shared paths."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray, percent: int):
        self.percent, self.vocabulary = percent, np.unique(np.concatenate(sets))
        self.rank = np.empty(len(self.vocabulary), np.int32)
        often = sketch[self.vocabulary & np.uint64(len(sketch) - 1)].astype(np.int64)
        self.rank[np.lexsort((self.vocabulary, -often))] = np.arange(len(self.vocabulary), dtype=np.int32)
        self.trie = build_trie([np.sort(self.rank[np.searchsorted(self.vocabulary, x)]) for x in sets], list(range(len(sets))))
        self.mask = np.zeros(len(self.vocabulary), bool)

    def matches(self, grams: np.ndarray) -> list[int]:
        """Places of the sets that reach the threshold with these n-grams."""
        at = np.searchsorted(self.vocabulary, grams)
        at[at == len(self.vocabulary)] = 0
        own = self.rank[at[self.vocabulary[at] == grams]]
        self.mask[own] = True
        found = list(walk(self.trie, len(grams), self.mask, self.percent))
        self.mask[own] = False
        return found


class Groups:
    """Links that are new between groups of rows."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        parent = self.parent
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def block_links(ids: list[int], sets: list[np.ndarray], sketch: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the sets of one block (a spanning forest)."""
    block, groups, done = Block(sets, sketch, percent), Groups(), set()
    while True:
        roots = [groups.root(i) for i in range(len(ids))]
        biggest = int(np.argmax(np.bincount(roots, minlength=len(ids))))
        waiting = [i for i in range(len(ids)) if i not in done and roots[i] != biggest] if done else [0]
        if not waiting:
            return
        for i in waiting[:16]:
            done.add(i)
            for j in block.matches(sets[i]):
                if groups.join(i, j):
                    yield ids[i], ids[j]


KEY = ["cluster", "class", "block", "slice"]


def trie_links(rows: DataFrame, sketch, cfg: JaccardConfig) -> DataFrame:
    """src, dst from rows (KEY, doc, probe, grams): one trie for each key.

    Without probes the sets of a key are linked among themselves, else the probes with the others. Probes come last, so no more than the sets of one block are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sets, block, groups, found = None, [], [], None, Groups(), []

        def made() -> pd.DataFrame:
            return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

        def finish() -> None:
            if block is None and len(ids) > 1:
                found.extend(block_links(ids, sets, sketch.value, cfg.percent))

        for frame in frames:
            columns = [frame[c].tolist() for c in (*KEY, "doc", "probe", "grams")]
            for cluster, kind, part, piece, doc, probe, grams in zip(*columns):
                if (cluster, kind, part, piece) != key:
                    finish()
                    key, ids, sets, block, groups = (cluster, kind, part, piece), [], [], None, Groups()
                grams = np.frombuffer(grams, np.uint64)
                if not probe:
                    ids.append(doc)
                    sets.append(grams)
                elif ids:
                    block = block or Block(sets, sketch.value, cfg.percent)
                    found += [(doc, ids[j]) for j in block.matches(grams) if groups.join(doc, ids[j])]
            yield made()
            found = []
        finish()
        yield made()

    dealt = rows.select(*KEY, "doc", "probe", "grams").repartition(*KEY).sortWithinPartitions(*KEY, "probe", "doc")
    return dealt.mapInPandas(run, "src long, dst long")


def _size_class(n: str, cfg: JaccardConfig) -> str:
    """Sets that reach the threshold together are in one class or in neighbouring ones."""
    return f"cast(floor(ln({n}) / {1.000001 * math.log(100 / cfg.percent)!r}D) as int)"


def _candidates(chosen: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Edges between sets (row, n, head) that may reach the threshold together."""
    p = cfg.percent
    entries = chosen.select(F.col("row").alias("doc"), "n", F.posexplode("head").alias("at", "gram")).repartition("gram")
    lists = entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    live = materialize(entries.join(lists, "gram"), "lists")
    # a pair has at most as many entries in long lists as either of its sets
    long = live.where(F.col("df") > cfg.short)
    few = live.where(F.col("df") <= cfg.short).join(long.groupBy("doc").agg(F.count("*").alias("far")), "doc", "left").select("gram", "doc", "n", "at", F.coalesce("far", F.lit(0)).alias("far"))
    pairs = few.alias("a").join(few.alias("b"), F.expr(f"a.gram = b.gram and a.doc < b.doc and 100 * least(a.n, b.n) >= {p} * greatest(a.n, b.n)"))
    counted = pairs.groupBy(F.col("a.doc").alias("src"), F.col("b.doc").alias("dst")).agg(
        F.count("*").alias("c"), F.first("a.n").alias("n1"), F.first("b.n").alias("n2"), F.min("a.at").alias("at1"), F.min("b.at").alias("at2"), F.first(F.least("a.far", "b.far")).alias("far"))
    # beyond a prefix lie ceil(t n) - 1 entries of a set; what is shared comes after the first shared place
    beyond = f"({p} * greatest(n1, n2) + 99) div 100 - 1"
    near = counted.where(f"least(c + far + {beyond}, n1 - at1, n2 - at2) * {100 + p} >= {p} * (n1 + n2)").select("src", "dst")

    # sizes of partners with whom this entry could be the first shared one
    low, high = f"({p} * n + 99) div 100", f"least(100 * n div {p}, (n - at) * {100 + p} div {p} - n)"
    ranged = long.select("gram", "doc", "n", F.expr(low).alias("low"), F.expr(high).alias("high"), F.expr(_size_class("n", cfg)).alias("class")).where("high >= low")
    hubs = ranged.where("high >= n").groupBy("gram", "class").agg(F.min("doc").alias("hub"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("high").alias("upto"))
    # an n-gram of very many sets has one row here for each class of sizes
    hubs = small_side(materialize(hubs, "hubs", small=True))
    asked = ranged.withColumn("class", F.explode(F.array("class", F.col("class") - 1)))
    met = asked.join(hubs, ["gram", "class"]).where("doc != hub and least <= n and upto >= n and most >= low and high >= least")
    return near.unionAll(met.select(F.col("doc").alias("src"), F.col("hub").alias("dst")).distinct())


def _deal(texts: DataFrame, clusters: DataFrame, edges: DataFrame, cfg: JaccardConfig) -> tuple[DataFrame, bool]:
    """Sets of clusters in their blocks (KEY, doc, probe, grams, home, n), written; whether any cluster has several blocks.

    ``home`` marks the block that a set belongs to, as hubs stand in others too.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("g")).where(f"c > {cfg.block} or g > {cfg.block_grams}")
    sizes = materialize(sizes.select("cluster"), "large", small=True)
    if sizes.isEmpty():
        placed = clusters.select("doc", "cluster", F.lit(0).alias("class"), F.lit(0).alias("block"), F.lit(True).alias("home"))
        several = False
    else:
        several = True
        large = clusters.join(small_side(sizes), "cluster").withColumn("class", F.expr(_size_class("n", cfg)))
        parts = large.groupBy("cluster", "class").agg(F.expr(f"cast(ceil(greatest(count(*) / {cfg.block}, sum(n) / {cfg.block_grams})) as int)").alias("blocks"))
        parts = materialize(parts, "parts", small=True)
        homes = large.join(small_side(parts), ["cluster", "class"]).select("doc", "cluster", "class", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block"), F.lit(True).alias("home"))
        # the sets with the most candidate links of each cluster stand in all blocks of their own and the neighbouring classes
        ends = edges.select(F.explode(F.array("src", "dst")).alias("doc")).groupBy("doc").agg(F.count("*").alias("degree"))
        ranked = large.join(ends, "doc").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "doc"))).where(F.col("r") <= cfg.hubs)
        near = ranked.select("doc", "cluster", F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class")).join(parts, ["cluster", "class"])
        guests = near.select("doc", "cluster", "class", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(False).alias("home"))
        guests = guests.join(homes.select("doc", "class", "block"), ["doc", "class", "block"], "left_anti").select(homes.columns)
        single = clusters.join(small_side(sizes), "cluster", "left_anti").select("doc", "cluster", F.lit(0).alias("class"), F.lit(0).alias("block"), F.lit(True).alias("home"))
        placed = single.unionAll(homes).unionAll(guests)
    placed = small_side(materialize(placed, "placed", small=True))
    rows = texts.join(placed, "doc").select("cluster", "class", "block", F.lit(0).alias("slice"), "doc", F.lit(False).alias("probe"), "home", "text")
    return materialize(gram_sets(rows, cfg), "sets"), several


def _outside_links(sets: DataFrame, links: DataFrame, large: DataFrame, sketch, cfg: JaccardConfig) -> DataFrame:
    """Links between groups of clusters of several blocks: sets outside the largest group walk the tries of neighbouring classes."""
    groups = materialize(connected_components(links).toDF("doc", "grp"), "groups", small=True)
    members = sets.where("home").select("cluster", "class", "block", "doc").join(large, "cluster", "left_semi").join(small_side(groups), "doc", "left").withColumn("grp", F.coalesce("grp", "doc"))
    members = materialize(members, "grouped", small=True)
    largest = members.groupBy("cluster", "grp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("grp", F.struct("c", "grp")).alias("top"))
    outside = members.join(small_side(materialize(largest, "largest", small=True)), "cluster").where("grp != top")
    blocks = members.groupBy("cluster", "class", "block").agg(F.count("*").alias("members"))
    asked = outside.select("cluster", "doc", F.explode(F.expr("array(class - 1, class, class + 1)")).alias("class"))
    slices = asked.groupBy("cluster", "class").agg(F.ceil(F.count("*") / cfg.slice).cast("int").alias("slices"))
    plan = materialize(blocks.join(slices, ["cluster", "class"]).select("cluster", "class", "block", "slices"), "probed", small=True)
    index = sets.where("home").join(small_side(plan), ["cluster", "class", "block"]).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    walks = asked.join(small_side(plan), ["cluster", "class"]).select("cluster", "class", "block", F.pmod(F.xxhash64("doc", F.lit(1)), "slices").cast("int").alias("slice"), "doc")
    probes = sets.where("home").select("doc", "grams").join(walks, "doc").withColumn("probe", F.lit(True))
    columns = [*KEY, "doc", "probe", "grams"]
    return materialize(trie_links(index.select(columns).unionAll(probes.select(columns)), sketch, cfg), "links")


def _answers(docs: DataFrame, heads: DataFrame, sketch, cfg: JaccardConfig) -> DataFrame:
    """digest and component_id of all sets that occur more than once or are linked, written."""
    # broadcast if small, else a class of very many copies can be split between tasks
    classes = heads.where("n > 0").groupBy("digest").agg(F.min(F.expr("if(doc_id is null, null, row)")).alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = materialize(classes, "classes", small=True)
    chosen = heads.where("n > 0 and doc_id is not null").join(small_side(classes), "digest", "left").where("rep is null or rep = row").withColumn("low", F.coalesce("low", "doc_id"))

    edges = materialize(_candidates(chosen, cfg), "edges")
    found = materialize(connected_components(edges).toDF("row", "cluster"), "found", small=True)
    clusters = materialize(chosen.select("row", "n", "doc_id", "mark", "digest", "low").join(small_side(found), "row").withColumnRenamed("row", "doc"), "clusters", small=True)
    # rows of one doc_id with equal texts are one class, so these two name a chosen row; a row that is repeated is taken once
    named = small_side(clusters.select("doc_id", "mark", "doc"))
    repeated = heads.select("doc_id", "mark").join(named, ["doc_id", "mark"]).groupBy("doc").agg(F.count("*").alias("c")).where("c > 1")
    repeated = materialize(repeated.select("doc"), "repeated", small=True)
    texts = docs.join(named, ["doc_id", "mark"]).select("doc", "text")
    if not repeated.isEmpty():
        once = texts.join(small_side(repeated), "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
        texts = texts.join(small_side(repeated), "doc", "left_anti").unionAll(once)
    sets, several = _deal(texts, clusters.select("doc", "n", "cluster"), edges, cfg)
    links = materialize(trie_links(sets, sketch, cfg), "links")
    if several:
        large = sets.where("class != 0 or block != 0").select("cluster").distinct()
        links = links.unionAll(_outside_links(sets, links, small_side(materialize(large, "large", small=True)), sketch, cfg))

    joined = connected_components(links).toDF("doc", "component")
    linked = materialize(clusters.select("doc", "digest", "low").join(joined, "doc"), "linked", small=True)
    # a component of very many sets has one row here
    lows = small_side(materialize(linked.groupBy("component").agg(F.min("low").alias("component_id")), "lows", small=True))
    answers = linked.join(lows, "component").select("digest", "component_id")
    answers = answers.unionAll(classes.join(linked.select("digest"), "digest", "left_anti").select("digest", "low"))
    return materialize(answers, "components", small=True, keep=True)


def jaccard_rows(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles and component_id for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketch = spark.sparkContext.broadcast(count_sketch(docs, cfg))
    # the number of a row is fixed by the written table
    heads = materialize(prefixes(docs, sketch, cfg).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    with temporary(spark):
        answers = small_side(_answers(docs, heads, sketch, cfg))
    out = heads.select("doc_id", "mark", "n", "digest").join(answers, "digest", "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    return jaccard_rows(docs, cfg).drop("mark")
