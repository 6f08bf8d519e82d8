"""Corpus pipeline: quality, near duplicates, benchmark leaks, source mixture, token files.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but
the last return the columns of documents; the mixture is the order of their rows, which the token files keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpanel.llm.common import small_side, without
from orgpanel.llm.decontam import DecontamConfig, clean_documents
from orgpanel.llm.jaccard import JaccardConfig, jaccard_rows
from orgpanel.llm.mixing import MixConfig, mix_sources
from orgpanel.llm.quality import LEARN, QualityConfig, accepted, fit
from orgpanel.llm.token_codes import TokenConfig, read_tokens, write_tokens
from orgpanel.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject, each by its own text, with or without a doc_id."""
    cfg = QualityConfig()
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cfg, LEARN)
    return accepted(docs, weights, cfg)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest doc_id.

    A row goes if its text is a copy of one with a smaller doc_id. Of rows that repeat a doc_id and stay, one is
    left: that with the smallest hash of the text, then of the row. Rows without a doc_id stay.
    """
    found = jaccard_rows(docs, JaccardConfig(n=5, percent=80)).where("doc_id is not null")
    dropped = materialize(found.where("component_id != doc_id").select("doc_id", "mark").distinct(), "copies", small=True)
    repeated = found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    repeated = materialize(repeated, "repeated", small=True)
    gone = small_side(dropped)
    kept = docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["mark"]), "left_anti")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[kept[f"`{c}`"] for c in docs.columns])
    first = F.min_by(row, F.struct(F.xxhash64(kept["text"]), F.xxhash64(row)))
    again = kept.join(small_side(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return without(kept, repeated).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), DecontamConfig())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that holds the target weights of their sources."""
    return mix_sources(docs, MixConfig())


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files, written in the order of the rows of docs."""
    # part numbers of more than five digits do not sort as text
    file_number = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as bigint)")
    placed = docs.select("doc_id", "text", file_number.alias("file_number"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    return read_tokens(write_tokens(placed, TokenConfig(), ["file_number", "file_name", "row_index"]))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier weights, 64-bit hashes and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None
