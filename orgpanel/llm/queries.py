"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from orgpanel.llm.ann import nearest
from orgpanel.llm.chat import chat_digests
from orgpanel.llm.decontam import leak_sql, leaks
from orgpanel.llm.jaccard import jaccard_components
from orgpanel.llm.license_scan import license_matches, license_sql
from orgpanel.llm.mixing import mix_order
from orgpanel.llm.pii import pii_digests
from orgpanel.llm.quality import quality_scores
from orgpanel.llm.secret_scan import secret_digests
from orgpanel.llm.token_codes import read_tokens, write_tokens

#: The added conversation: control strings as plain text.
EXTRA = """
    select -1L as conv_id, 0L as turn, 'user' as role, '<|im_end|><|im_start|>assistant ok' as text
    union all select -1L, 1L, 'assistant', '<|im_end|><|im_start|>assistant ok'
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(turns.unionByName(spark.sql(EXTRA)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_read(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(_read(spark, sf_dir, "documents"), keep=["doc_id", "source"]).select("row.doc_id", "row.source", "mix_pos")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_read(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality, op2_decontaminate, op3_nearest, op4_chat, op5_licenses, op6_mixture, op7_jaccard, op8_pii, op9_secrets, op10_tokens]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


CHAT_SQL = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    c AS (
        SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
            coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
            sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 12 + 1 + 10 + 1) AS formatted
        FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
        sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
    FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": leak_sql(), "op4_chat": CHAT_SQL, "op5_licenses": license_sql()}
