"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

A text becomes a sparse vector: tokens are word runs and symbol runs, each token and each pair
of neighbours is hashed to one of ``2**bits`` places (all pairs of equal tokens to one place, and
equal tokens two apart to another), counts are damped by a logarithm and the
vector is scaled to length one. The weights are learned one document at a time with per-place
FTRL-proximal steps; a score is the logistic of one sparse dot product.

Fitting uses at most ``max_train`` labelled rows (the documented bound), those with the smallest
hash of doc_id, so the same rows are taken on every run. The sample goes through one task and
only the fixed-size weight vector comes to the driver. Scoring reads every whole text once and
shuffles nothing.

Edge cases: a null or empty text has no features and scores the bias alone; a null or missing
label, or a label other than 0 and 1, is not learned from; several labels of one doc_id count as
their minimum; with no usable label all weights are 0 and every score is 0.5; rows that repeat a
doc_id are learned from once (the smallest text) and scored as often as they occur; columns beyond doc_id and text are ignored; a null doc_id is
scored and counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"\w+|[^\w\s]+"
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands for every pair of equal tokens, whatever they are: unseen words that repeat share it.
AGAIN = np.uint64(0xD1B54A32D192ED03)
APART = np.uint64(0xAEF17502108EF2D9)


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 20
    max_train: int = 8192
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    threshold: float = 0.7


def featurizer(bits: int):
    """text -> (places, values), the sparse unit vector of a text."""
    import re

    import xxhash

    tokens, digest, shift = re.compile(TOKEN).findall, xxhash.xxh3_64_intdigest, np.uint64(64 - bits)

    def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = tokens(text or "")
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        one = np.fromiter(map(digest, found), np.uint64, len(found))
        two = (one[:-1] * ODD) ^ (one[1:] + (one[:-1] >> np.uint64(29)))
        two[one[:-1] == one[1:]] = AGAIN
        apart = np.full(np.count_nonzero(one[:-2] == one[2:]), APART)
        places, counts = np.unique(np.concatenate([one * ODD, two * ODD, apart * ODD]) >> shift, return_counts=True)
        values = 1 + np.log(counts)
        return places.astype(np.int64), values / np.sqrt(values @ values)

    return features


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], cfg: QualityConfig) -> np.ndarray:
    """Weights after ``epochs`` passes; the last place is the bias, which is not shrunk."""
    size = (1 << cfg.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        push = z[at]
        w = -(push - np.sign(push) * cfg.l1) / ((cfg.beta + np.sqrt(n[at])) / cfg.alpha + cfg.l2)
        w[np.abs(push) <= cfg.l1] = 0
        bias = at == size - 1
        w[bias] = -push[bias] / ((cfg.beta + np.sqrt(n[at[bias]])) / cfg.alpha)
        return w

    for _ in range(cfg.epochs):
        for places, values, label in rows:
            at, x = np.append(places, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / cfg.alpha * w
    return weights(np.arange(size)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), learn=None) -> np.ndarray:
    """Weights from labelled documents; ``learn`` is a condition on doc_id for rows to learn from."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_train)
    # rows that repeat a doc_id count once, so the sample stays bounded
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = featurizer(cfg.bits)
        for b in batches:
            for doc, text, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))):
                places, values = features(text)
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "y": pa.array([y], pa.int32()), "p": [places.astype(np.int32).tobytes()], "v": [values.astype(np.float32).tobytes()]})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for p, v, y in zip(*(b.column(c).to_pylist() for c in ("p", "v", "y"))):
                rows.append((np.frombuffer(p, np.int32), np.frombuffer(v, np.float32), y))
        yield pa.RecordBatch.from_pydict({"w": [ftrl(rows, cfg).tobytes()]})

    made = sample.mapInArrow(vectors, "doc_id long, y int, p binary, v binary")
    one = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "p")
    got = one.mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(got[0].w), np.float32) if got else np.zeros((1 << cfg.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, score and predicted for every row of docs, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = featurizer(cfg.bits), shared.value.astype(np.float64)
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column("text")):
                places, values = features(text.as_py())
                out[i] = w[-1] + w[places] @ values
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def accepted(docs: DataFrame, weights: np.ndarray, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs whose own text scores at least the threshold, all columns kept; all rows if nothing was learned."""
    if not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = featurizer(cfg.bits), shared.value.astype(np.float64)
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(at)):
                places, values = features(text.as_py())
                out[i] = w[-1] + w[places] @ values
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))) >= cfg.threshold))

    return docs.mapInArrow(run, docs.schema)


LEARN = "crc32(cast(doc_id as string)) % 4 != 2"


def quality_scores(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The contract of op1: fit on the rows that are not held out, score all."""
    weights = fit(docs, labels, cfg, LEARN)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, weights, cfg).select("doc_id", held.alias("held_out"), "score", "predicted")
