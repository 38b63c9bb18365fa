"""Loads of a graph onto an existing one."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import load as ld
from graphloom.operators import quality as qa
from graphloom.plans.quality_queries import EDGES_SQL, dirty_edges, dirty_nodes
from graphloom.plans.registry import query
from graphloom.plans.trade import load
from graphloom.schema import TRADE

OK_SQL = "label IN ('Region', 'Nation', 'Customer', 'Supplier', 'Part') AND trim(name) <> ''"
NODES_SQL = f"""{EDGES_SQL}, r AS (SELECT node_id, name, label, source_doc_ids, description, seq FROM n WHERE {OK_SQL} UNION ALL SELECT node_id, name || ' again', label, source_doc_ids, 'later', seq + 1000000 FROM n WHERE {OK_SQL} AND seq % 5 = 0),
t AS (SELECT label, node_id, 'old' AS name, source_doc_ids, 'kept' AS description FROM n WHERE seq % 2 = 0),
f AS (SELECT label, node_id, name, source_doc_ids, description FROM (SELECT *, row_number() OVER (PARTITION BY label, node_id ORDER BY seq DESC) AS rn FROM r) WHERE rn = 1),
g AS (SELECT * FROM f UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.label = t.label AND f.node_id = t.node_id))"""


def merged_nodes(spark, d):
    rows = qa.import_nodes(dirty_nodes(spark, d), TRADE).filter("ok")
    again = rows.filter("seq % 5 = 0").withColumns({"name": F.concat("name", F.lit(" again")), "description": F.lit("later"), "seq": F.col("seq") + 1_000_000})
    target = dirty_nodes(spark, d).filter("seq % 2 = 0").withColumns({"name": F.lit("old"), "description": F.lit("kept")}).drop("seq")
    return ld.upsert_nodes(target, rows.unionByName(again))


@query(f"WITH {NODES_SQL} SELECT label, node_id, name, source_doc_ids, description FROM g")
def load_nodes(spark, d):
    return merged_nodes(spark, d)


@query(
    f"""WITH {NODES_SQL}, er AS (SELECT src, dst, rel_type, source_doc_id, evidence, coalesce(confidence, 0) AS confidence, section FROM je WHERE rel_type = 'SUPPLIES' AND src LIKE 'Supplier:%' AND src IN (SELECT node_id FROM g) AND dst IN (SELECT node_id FROM g)),
ef AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel_type, source_doc_id ORDER BY (confidence, evidence, section) DESC) AS rn FROM er) WHERE rn = 1),
et AS (SELECT DISTINCT src, dst, rel_type, source_doc_id, 'old' AS evidence, CAST(0.5 AS DOUBLE) AS confidence, '' AS section FROM je WHERE CAST(source_doc_id AS BIGINT) % 9 = 0)
SELECT src, dst, rel_type, source_doc_id, evidence, format('{{:.2f}}', confidence) AS confidence, section FROM (SELECT * FROM ef UNION ALL SELECT * FROM et WHERE NOT EXISTS (SELECT 1 FROM ef WHERE ef.src = et.src AND ef.dst = et.dst AND ef.rel_type = et.rel_type AND ef.source_doc_id = et.source_doc_id))"""
)
def load_edges(spark, d):
    rows = qa.import_edges(dirty_edges(spark, d), TRADE).filter("ok").withColumn("seq", F.struct("confidence", "evidence", "section"))
    target = dirty_edges(spark, d).filter("cast(source_doc_id as bigint) % 9 = 0").select("src", "dst", "rel_type", "source_doc_id").distinct()
    target = target.withColumns({"evidence": F.lit("old"), "confidence": F.lit(0.5), "section": F.lit("")})
    out = ld.upsert_edges(target, rows, merged_nodes(spark, d))
    return out.withColumn("confidence", F.format_string("%.2f", "confidence"))


@query("SELECT p_partkey AS k, regexp_full_match(name, '[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*') AS safe FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN '__' ELSE p_brand || '`' END AS name FROM part)")
def load_identifiers(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 4 == 2, "__").otherwise(F.concat("p_brand", F.lit("`")))
    return load(spark, d, "part").select(k.alias("k"), ld.is_identifier(name).alias("safe"))
