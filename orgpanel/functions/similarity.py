"""Shingles, decaying weights, SimHash signatures and edit similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def shingles(text: Column, k: int = 2) -> Column:
    """All substrings of k characters in order; shorter texts are one shingle, the empty text too."""
    parts = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) >= k, parts).otherwise(F.array(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def decay(items: Column) -> Column:
    """Weights from 1 down to 0 over the items of an array; a single item has weight 1."""
    n = F.size(items)
    return F.transform(items, lambda _, i: F.when(n == 1, 1.0).otherwise(1.0 - i / (n - 1)))


def md5_hash(text: Column) -> Column:
    """The first 64 bits of the md5, a hash that other engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def simhash_native(features: Column, weights: Column) -> Column:
    """Signature from integer weights and md5 hashes: bit j is set if the signed sum of weights is at least 0."""
    hashed = F.zip_with(features, weights, lambda f, w: F.struct(md5_hash(f).alias("h"), F.round(w * 1000000).cast("long").alias("w")))
    sums = F.aggregate(
        hashed,
        F.array_repeat(F.lit(0).cast("long"), 64),
        lambda acc, x: F.transform(acc, lambda v, j: v + F.when(F.call_function("getbit", x["h"], j) == 1, x["w"]).otherwise(-x["w"])),
    )
    bits = F.transform(sums, lambda v, j: F.when(v >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@F.pandas_udf(LongType())
def simhash(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signature of a name: xxHash64 (seed 0) of its 2-shingles and words, decaying weights, 32-bit sums in order."""
    import xxhash

    bit = np.arange(64, dtype=np.uint64)

    def one(name: str | None):
        if name is None:
            return None
        pieces = [name[i : i + 2] for i in range(len(name) - 1)] or [name]
        tokens = name.split()
        weight = np.concatenate([np.linspace(1, 0, len(pieces)), np.linspace(1, 0, len(tokens))]).astype(np.float32)
        h = np.array([xxhash.xxh64_intdigest(x) for x in pieces + tokens], np.uint64)
        signs = np.where((h[:, None] >> bit) & np.uint64(1), weight[:, None], -weight[:, None])
        on = np.add.accumulate(signs, axis=0, dtype=np.float32)[-1] >= 0
        return int(np.packbits(on, bitorder="little").view(np.int64)[0])

    for batch in names:
        yield batch.map(one).astype("Int64")


def band(signature: Column, k: int, bits: int = 8) -> Column:
    """The k-th group of bits, lowest first."""
    return F.shiftrightunsigned(signature, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longer)
