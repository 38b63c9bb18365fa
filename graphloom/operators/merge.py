"""Merging rows of one key by built-in aggregates, so that they combine before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ("src", "dst", "rel_type", "source_doc_id")


def best_edges(edges: DataFrame, order: tuple[str, ...] = ("evidence", "section"), key: tuple[str, ...] = EDGE_KEY) -> DataFrame:
    """One row per edge key: the greatest confidence, ties to the least of ``order``.

    Few edges share a key, so that combining them before they are shuffled would only sort and spill them all once more.
    """
    rest = [c for c in ("evidence", "section", "confidence") if c not in order]
    best = F.min(F.struct((-F.col("confidence")).alias("less"), *order, *rest)).alias("best")
    return edges.repartition(*key).groupBy(*key).agg(best).select(*key, "best.evidence", "best.confidence", "best.section")


def merge_nodes(nodes: DataFrame, longest: bool) -> DataFrame:
    """One row per node_id: all document ids in order, and one description.

    nodes(node_id, name, label, docs array, description, seq). The description is the first by ``seq`` that
    isn't empty, or with ``longest`` the longest, first on ties.
    """
    size = F.length("description")
    pick = F.when(size > 0, F.struct((-size if longest else F.lit(0)).alias("a"), "seq", "description"))
    merged = nodes.groupBy("node_id").agg(F.min("name").alias("name"), F.min("label").alias("label"), F.flatten(F.collect_set("docs")).alias("docs"), F.min(pick).alias("pick"))
    return merged.select("node_id", "name", "label", F.array_sort(F.array_distinct("docs")).alias("docs"), F.coalesce("pick.description", F.lit("")).alias("description"))


def latest(rows: DataFrame, key: tuple[str, ...], by: str) -> DataFrame:
    """The newest row of each key; ties go to the greatest row."""
    rest = [c for c in rows.columns if c not in key and c != by]
    newest = rows.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("r"))
    return newest.select(*key, *[F.col(f"r.`{c}`").alias(c) for c in (by, *rest)])
