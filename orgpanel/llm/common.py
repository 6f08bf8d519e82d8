"""Joins against tables of ids whose size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few integers each: about 40 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def small_side(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` (a written table of a few integers a row) to broadcast if it has at most ``rows`` rows.

    Beyond that the same join shuffles both sides by the id.
    """
    return F.broadcast(ids) if ids.count() <= rows else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ``ids``, all columns kept; rows with a null doc_id stay."""
    return docs.join(small_side(ids), "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
