"""Queries of this subpackage: one per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat_expand, divergence_rules, html_extract, lm_score, pair_bpe, probminhash, tiling, viterbi_count, warc_writer, weak_pii

#: Files of the queries; the operators take any path.
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.query(table(spark, sf_dir, "pages"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.query(table(spark, sf_dir, "documents"))


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.query(table(spark, sf_dir, "documents"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.query(table(spark, sf_dir, "documents"))


def op5_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.query(table(spark, sf_dir, "documents"))


def op6_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_count.query(table(spark, sf_dir, "documents"), PIECES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_writer.query(table(spark, sf_dir, "pages"))


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_expand.query(table(spark, sf_dir, "conversations"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.query(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tag_paths, op2_deleted_interpolation, op3_divergence, op4_probminhash, op5_weak_pii, op6_viterbi, op7_warc, op8_prefix_targets, op9_bpe, op10_tiling)}


#: Base 32 of the SHA-1, five bits at a time from two hexadecimal digits.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((instr('0123456789abcdef', substr(hex, 1 + CAST(floor(5 * i / 4) AS INTEGER), 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, 2 + CAST(floor(5 * i / 4) AS INTEGER), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INTEGER)) % 32, 1)), '')"

SQL = {
    "op7_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
 d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""",
    "op8_prefix_targets": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 e AS (SELECT *, 11 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C')) + length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) AS size FROM t),
 w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
