"""Corpus pipeline: quality rules, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages decide row by row: repeated rows, nulls in any column, empty and long texts and
empty tables pass through each of them as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import divergence_rules, pair_bpe, probminhash, tiling, weak_pii
from graphloom.llm._common import discard, materialize, scratch
from graphloom.llm.registry import BYTE_BPE, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep."""
    return divergence_rules.judge(docs).filter("kept").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id, and of its repeated rows one. Rows with a null id stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    classes = probminhash.near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    first = docs.join(classes, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id")
    once = first.join(repeated, "doc_id", "left_anti")
    # rows of one id that occurs again: the least row as JSON, so that columns of any type have an order
    row = F.struct(*names)
    others = first.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.select(*names).unionByName(others).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return tiling.mark_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data in ``text`` replaced by its kind; ``n_chars`` follows."""
    found = weak_pii.detect(docs)
    text = F.when(F.size("spans") > 0, weak_pii.redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    clean = found.select("row", text.alias("clean"), (F.size("spans") > 0).alias("changed"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return clean.select(*[column.alias(c) for c, column in columns.items()])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text."""
    return pair_bpe.query(docs, BYTE_BPE)


STAGES = [
    ("quality", quality),
    ("dedup", dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Most stages can't be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's own tables, and its input, go once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            out = materialize(stage(spark, docs, sf_dir), name)
            keep(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
