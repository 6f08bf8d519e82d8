"""Scans that turn bulk files into one row for each record.

Spark's text source splits files at the end tag of a record (or at its first tag line), so one large file feeds many
tasks, and everything outside records (prologues, document types, entities) falls away. A record that does not parse goes to
a quarantine table with its reason; the others of its file go on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

XML_OWN = {"amp", "lt", "gt", "quot", "apos"}


def text_chunks(spark: SparkSession, path: str | list[str], separator: str, glob: str | None = None) -> DataFrame:
    """(file, pos, chunk): pieces of files between separators as bytes; pos orders the pieces of a file."""
    reader = spark.read.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))
    # blocks of a file are read in order within a task, so the running id orders its pieces
    return found.select("file", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("pos"), "chunk")


def mend_entities(text: str) -> str:
    """Named entities of HTML to characters; unknown ones are dropped, those of XML stay."""

    def one(m: re.Match) -> str:
        if m[1] in XML_OWN:
            return m[0]
        found = html.unescape(m[0])
        return "" if found == m[0] else found

    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", one, text)


def parse_records(chunks: DataFrame, build: Callable[[bytes, str], dict | None], fields: str) -> DataFrame:
    """Rows of ``fields`` (a DDL string) from chunks, with file, pos and error; ``build`` gives None for no record.

    Python is needed here as a record is a small document: one parse serves all fields.
    """
    kind = StructType.fromDDL(fields)
    names = kind.fieldNames()
    out = StructType([*kind.fields, StructField("file", StringType()), chunks.schema["pos"], StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, pos, chunk in zip(frame["file"], frame["pos"], frame["chunk"]):
                try:
                    got = build(bytes(chunk), file)
                    if got is not None:
                        rows.append([*(got.get(n) for n in names), file, pos, None])
                except Exception as e:  # noqa: BLE001  the record goes to the quarantine
                    rows.append([*(None for _ in names), file, pos, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=out.fieldNames(), dtype=object)

    return chunks.mapInPandas(run, out)


def xml_record(chunk: bytes, tag: str) -> ElementTree.Element | None:
    """The element that ends this chunk (its end tag is the separator), or None."""
    text = chunk.decode("utf-8", "ignore")
    start = re.search(rf"<{tag}[\s>]", text)
    if not start:
        return None
    return ElementTree.fromstring(mend_entities(text[start.start() :]) + f"</{tag}>")


def text_at(node: ElementTree.Element | None, path: str, default: str = "") -> str:
    """Text before the first child of the first element at path: trimmed, lower case."""
    child = node.find(path) if node is not None else None
    return default if child is None or child.text is None else child.text.strip().lower()


def all_text(node: ElementTree.Element, separator: str = "") -> str:
    return separator.join(node.itertext()).strip().lower()


def good(parsed: DataFrame) -> DataFrame:
    """Records that parsed, with empty text as null."""
    kept = parsed.where("error is null").drop("error")
    return kept.select([F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in kept.schema.fields])


def file_counts(parsed: DataFrame) -> DataFrame:
    """(file, n_records, n_bad) of a scan."""
    return parsed.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("n_records"), F.count_if(F.col("error").isNotNull()).alias("n_bad"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("file", "pos", "error")
