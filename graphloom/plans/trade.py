"""The five-label graph on the trade tables, as frames and as the same tables in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import EdgesAt, small
from graphloom.schema import TRADE


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(label: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("Region", "region", "r_regionkey", "r_name", "''"), ("Nation", "nation", "n_nationkey", "n_name", "''"), ("Customer", "customer", "c_custkey", "c_name", "c_mktsegment"), ("Supplier", "supplier", "s_suppkey", "s_name", "cast(null as string)"), ("Part", "part", "p_partkey", "p_name", "p_type")]
    return reduce(
        DataFrame.unionByName,
        [
            load(spark, sf_dir, table).select(_id(label, key).alias("node_id"), F.col(name).alias("name"), F.lit(label).alias("label"), F.lit(i).alias("category"), F.expr(text).alias("description"))
            for i, (label, table, key, name, text) in enumerate(parts)
        ],
    )


#: Rows that may travel by way of the driver, to be joined without a shuffle of the other table.
FEW = 100_000


def raw_edges(spark: SparkSession, sf_dir: str, customers: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """Edges as they are met, several per (src, dst, rel_type, source_doc_id).

    BOUGHT only of ``customers`` or of ``parts``, where ids are given: few rows of one table then meet the other's
    scan. Types of which neither list says anything come whole.
    """
    fixed = lambda t, src, dst, kind: t.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("rel_type"), F.lit("").alias("source_doc_id"), F.lit("").alias("evidence"), F.lit(1.0).alias("confidence"), F.lit("").alias("section"))
    nation, customer, supplier = (load(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        _id("Part", "l_partkey").alias("part"),
        _id("Supplier", "l_suppkey").alias("supplier"),
        F.col("l_orderkey").cast("string").alias("source_doc_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("evidence"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.col("l_returnflag").alias("section"),
    )
    orders, sold = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines
    if customers is not None:
        orders = small(orders.filter(_id("Customer", "o_custkey").isin(customers)), FEW)
    if parts is not None:
        sold = small(lines.filter(F.col("part").isin(parts)), FEW)
    bought = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rest = ["source_doc_id", "evidence", "confidence", "section"]
    return reduce(
        DataFrame.unionByName,
        [
            fixed(nation, _id("Nation", "n_nationkey"), _id("Region", "n_regionkey"), "IN_REGION"),
            fixed(customer, _id("Customer", "c_custkey"), _id("Nation", "c_nationkey"), "LIVES_IN"),
            fixed(supplier, _id("Supplier", "s_suppkey"), _id("Nation", "s_nationkey"), "BASED_IN"),
            lines.select(F.col("supplier").alias("src"), F.col("part").alias("dst"), F.lit("SUPPLIES").alias("rel_type"), *rest),
            bought.select(_id("Customer", "o_custkey").alias("src"), F.col("part").alias("dst"), F.lit("BOUGHT").alias("rel_type"), *rest),
        ],
    )


def edges(spark: SparkSession, sf_dir: str, **some: list[str] | None) -> DataFrame:
    """One edge per (src, dst, rel_type, source_doc_id): that of the greatest confidence. ``some`` as in ``raw_edges``."""
    from graphloom.operators.merge import best_edges

    key = ["src", "dst", "rel_type", "source_doc_id"]
    return best_edges(raw_edges(spark, sf_dir, **some)).select(F.concat_ws("|", *key).alias("edge_id"), *key, "evidence", "confidence", "section")


def edges_at(spark: SparkSession, sf_dir: str) -> EdgesAt:
    """Edges at few nodes: only of the types that the schema allows there, as an id says its node's label."""

    def at(column: str, ids: list[str]) -> DataFrame:
        labels = {i.partition(":")[0] for i in ids}
        types = [t for t, ends in TRADE.relations.items() if ends[column == "dst"] in labels]
        near = "BOUGHT" in types
        found = edges(spark, sf_dir, customers=ids if near and column == "src" else None, parts=ids if near and column == "dst" else None)
        return found.filter(F.col("rel_type").isin(types) & F.col(column).isin(ids))

    return at


VERTICES_SQL = """v AS MATERIALIZED (
 SELECT 'Region:' || r_regionkey AS node_id, r_name AS name, 'Region' AS label, 0 AS category, '' AS description FROM region
 UNION ALL SELECT 'Nation:' || n_nationkey, n_name, 'Nation', 1, '' FROM nation
 UNION ALL SELECT 'Customer:' || c_custkey, c_name, 'Customer', 2, c_mktsegment FROM customer
 UNION ALL SELECT 'Supplier:' || s_suppkey, s_name, 'Supplier', 3, NULL FROM supplier
 UNION ALL SELECT 'Part:' || p_partkey, p_name, 'Part', 4, p_type FROM part)"""
EDGES_SQL = """raw AS MATERIALIZED (
 SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'IN_REGION' AS rel_type, '' AS source_doc_id, '' AS evidence, CAST(1.0 AS DOUBLE) AS confidence, '' AS section FROM nation
 UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'LIVES_IN', '', '', 1.0, '' FROM customer
 UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'BASED_IN', '', '', 1.0, '' FROM supplier
 UNION ALL SELECT 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'SUPPLIES', CAST(l_orderkey AS VARCHAR), concat_ws(' ', l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')), round(1 - l_discount, 2), l_returnflag FROM lineitem
 UNION ALL SELECT 'Customer:' || o_custkey, 'Part:' || l_partkey, 'BOUGHT', CAST(l_orderkey AS VARCHAR), concat_ws(' ', l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')), round(1 - l_discount, 2), l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS MATERIALIZED (
 SELECT src || '|' || dst || '|' || rel_type || '|' || source_doc_id AS edge_id, src, dst, rel_type, source_doc_id, evidence, confidence, section
 FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel_type, source_doc_id ORDER BY confidence DESC, evidence, section) AS rn FROM raw) WHERE rn = 1),
d AS MATERIALIZED (SELECT src AS a, dst AS b, edge_id, rel_type FROM e UNION ALL SELECT dst, src, edge_id, rel_type FROM e WHERE src <> dst)"""
GRAPH_SQL = f"WITH {VERTICES_SQL}, {EDGES_SQL}"
