"""The quality stage on the trade graph, made dirty by rules on the keys so that SQL can make the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import quality as qa
from graphloom.plans.registry import query
from graphloom.plans.trade import load
from graphloom.schema import TRADE

LEAST = 0.95


def dirty_nodes(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "").when(k % 13 == 0, "x").when(k % 19 == 0, F.concat(F.lit("患者"), "p_name")).otherwise(F.col("p_name"))
    parts = load(spark, d, "part").select(F.concat(F.lit("Part:"), k.cast("string")).alias("node_id"), name.alias("name"), F.when(k % 17 == 0, "Nothing").otherwise("Part").alias("label"), k.cast("string").alias("source_doc_ids"), F.col("p_type").alias("description"), k.alias("seq"))
    s = F.col("s_suppkey")
    suppliers = load(spark, d, "supplier").select(F.concat(F.lit("Supplier:"), s.cast("string")).alias("node_id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("label"), s.cast("string").alias("source_doc_ids"), F.lit("").alias("description"), s.alias("seq"))
    orphans = load(spark, d, "part").filter(k % 41 == 0).select(F.concat(F.lit("Part:o"), k.cast("string")).alias("node_id"), F.concat(F.lit("orphan "), k.cast("string")).alias("name"), F.lit("Part").alias("label"), F.lit("").alias("source_doc_ids"), F.lit("no edge").alias("description"), k.alias("seq"))
    return parts.unionByName(suppliers).unionByName(orphans)


def dirty_edges(spark, d):
    o = F.col("l_orderkey")
    part, supplier = F.concat(F.lit("Part:"), F.col("l_partkey").cast("string")), F.concat(F.lit("Supplier:"), F.col("l_suppkey").cast("string"))
    swap = o % 31 == 0
    return load(spark, d, "lineitem").select(
        F.when(swap, part).otherwise(supplier).alias("src"),
        F.when(swap, supplier).otherwise(part).alias("dst"),
        F.when(o % 23 == 0, "NO_SUCH").otherwise("SUPPLIES").alias("rel_type"),
        o.cast("string").alias("source_doc_id"),
        F.when(o % 37 == 0, "abc").otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("evidence"),
        F.when(o % 29 == 0, "abc").otherwise(F.format_string("%.2f", F.round(1 - F.col("l_discount"), 2))).alias("confidence"),
        F.col("l_returnflag").alias("section"),
    )


def judged_nodes(spark, d):
    plain = lambda name, label: F.trim(name)
    reason = lambda name, label: qa.node_reason(name, label, TRADE, {}, generic_by_label={}, fragments_by_label={})
    return qa.judge_nodes(dirty_nodes(spark, d), plain, reason)


def judged_edges(spark, d):
    return qa.judge_edges(dirty_edges(spark, d), judged_nodes(spark, d), TRADE, LEAST)


NODES_SQL = """n AS (SELECT 'Part:' || p_partkey AS node_id, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'x' WHEN p_partkey % 19 = 0 THEN '患者' || p_name ELSE p_name END AS name,
  CASE WHEN p_partkey % 17 = 0 THEN 'Nothing' ELSE 'Part' END AS label, CAST(p_partkey AS VARCHAR) AS source_doc_ids, p_type AS description, p_partkey AS seq FROM part
 UNION ALL SELECT 'Supplier:' || s_suppkey, s_name, 'Supplier', CAST(s_suppkey AS VARCHAR), '', s_suppkey FROM supplier
 UNION ALL SELECT 'Part:o' || p_partkey, 'orphan ' || p_partkey, 'Part', '', 'no edge', p_partkey FROM part WHERE p_partkey % 41 = 0),
jn AS (SELECT *, CASE WHEN label NOT IN ('Region', 'Nation', 'Customer', 'Supplier', 'Part') THEN 'invalid_node_label' WHEN name = '' THEN 'empty_name' WHEN contains(name, '患者') THEN 'bad_fragment:患者' WHEN length(name) < 2 THEN 'too_short' END AS reason,
  label || ':' || sha1(label || ':' || name) AS cid FROM n)"""
EDGES_SQL = f"""{NODES_SQL},
x AS (SELECT CASE WHEN l_orderkey % 31 = 0 THEN 'Part:' || l_partkey ELSE 'Supplier:' || l_suppkey END AS src, CASE WHEN l_orderkey % 31 = 0 THEN 'Supplier:' || l_suppkey ELSE 'Part:' || l_partkey END AS dst,
  CASE WHEN l_orderkey % 23 = 0 THEN 'NO_SUCH' ELSE 'SUPPLIES' END AS rel_type, CAST(l_orderkey AS VARCHAR) AS source_doc_id,
  CASE WHEN l_orderkey % 37 = 0 THEN 'abc' ELSE concat_ws(' ', l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')) END AS evidence,
  CASE WHEN l_orderkey % 29 = 0 THEN 'abc' ELSE format('{{:.2f}}', round(1 - l_discount, 2)) END AS given, l_returnflag AS section FROM lineitem),
je AS (SELECT x.*, try_cast(given AS DOUBLE) AS confidence, a.cid AS new_src, b.cid AS new_dst,
  CASE WHEN rel_type <> 'SUPPLIES' THEN 'invalid_relationship_type' WHEN try_cast(given AS DOUBLE) IS NULL THEN 'invalid_confidence' WHEN try_cast(given AS DOUBLE) < {LEAST} THEN 'low_confidence'
   WHEN a.cid IS NULL OR b.cid IS NULL THEN 'endpoint_node_rejected_or_missing' WHEN NOT (a.label = 'Supplier' AND b.label = 'Part') THEN 'direction_or_label_mismatch:' || a.label || '->' || b.label
   WHEN length(evidence) < 4 THEN 'evidence_too_short' END AS reason
  FROM x LEFT JOIN (SELECT * FROM jn WHERE reason IS NULL) a ON a.node_id = x.src LEFT JOIN (SELECT * FROM jn WHERE reason IS NULL) b ON b.node_id = x.dst),
cn AS (SELECT cid AS node_id, min(name) AS name, min(label) AS label, coalesce(string_agg(DISTINCT nullif(source_doc_ids, ''), ';' ORDER BY nullif(source_doc_ids, '')), '') AS docs, arg_min(description, (-length(description), seq)) AS description FROM jn WHERE reason IS NULL GROUP BY cid),
ce AS (SELECT new_src AS src, new_dst AS dst, rel_type, source_doc_id, evidence, confidence, section FROM (SELECT *, row_number() OVER (PARTITION BY new_src, new_dst, rel_type, source_doc_id ORDER BY confidence DESC, evidence, section) AS rn FROM je WHERE reason IS NULL) WHERE rn = 1),
pk AS (SELECT * FROM cn WHERE label = 'Supplier' OR node_id IN (SELECT src FROM ce UNION SELECT dst FROM ce)),
pr AS (SELECT * FROM cn WHERE NOT (label = 'Supplier' OR node_id IN (SELECT src FROM ce UNION SELECT dst FROM ce)))"""


@query(f"WITH {NODES_SQL} SELECT coalesce(reason, 'kept') AS reason, label, count(*) AS n FROM jn GROUP BY ALL")
def qa_node_reasons(spark, d):
    return judged_nodes(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL} SELECT node_id, name, label, docs, description FROM cn")
def qa_nodes_merged(spark, d):
    return qa.clean_nodes(judged_nodes(spark, d)).withColumn("docs", F.concat_ws(";", "docs"))


@query(f"WITH {EDGES_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM je GROUP BY reason")
def qa_edge_reasons(spark, d):
    return judged_edges(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, rel_type, source_doc_id, evidence, format('{{:.2f}}', confidence) AS confidence, section FROM ce")
def qa_edges_clean(spark, d):
    return qa.clean_edges(judged_edges(spark, d)).withColumn("confidence", F.format_string("%.2f", "confidence"))


def _pruned(spark, d):
    return qa.prune(qa.clean_nodes(judged_nodes(spark, d)), qa.good_edges(judged_edges(spark, d)), "Supplier")


@query(f"WITH {EDGES_SQL} SELECT node_id, name, label FROM pk")
def qa_prune_keep(spark, d):
    return _pruned(spark, d)[0].select("node_id", "name", "label")


@query(f"WITH {EDGES_SQL} SELECT node_id, name, label FROM pr")
def qa_prune_reject(spark, d):
    return _pruned(spark, d)[1].select("node_id", "name", "label")


@query(f"WITH {EDGES_SQL} SELECT src, dst, rel_type, source_doc_id FROM ce WHERE src IN (SELECT node_id FROM pk) AND dst IN (SELECT node_id FROM pk)")
def qa_final_edges(spark, d):
    # pruning takes no end of a clean edge: that node has an edge
    return qa.postprocess(judged_nodes(spark, d), judged_edges(spark, d), "Supplier").edges.select("src", "dst", "rel_type", "source_doc_id")


@query(
    f"""WITH {EDGES_SQL} SELECT 'node' AS item_type, reason, node_id AS id, name, label AS type, '' AS start_id, '' AS end_id, '' AS relationship_type, '' AS confidence, '' AS evidence, source_doc_ids AS source_doc_id FROM jn WHERE reason IS NOT NULL
 UNION ALL SELECT 'relationship', reason, '', '', '', src, dst, rel_type, given, evidence, source_doc_id FROM je WHERE reason IS NOT NULL
 UNION ALL SELECT 'node', 'unreferenced_after_relationship_filter', node_id, name, label, '', '', '', '', '', docs FROM pr"""
)
def qa_rejects(spark, d):
    return qa.postprocess(judged_nodes(spark, d), judged_edges(spark, d), "Supplier").rejects


@query(
    f"""WITH {EDGES_SQL}, fe AS (SELECT * FROM ce WHERE src IN (SELECT node_id FROM pk) AND dst IN (SELECT node_id FROM pk)),
c AS (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM pk) AS b, (SELECT count(*) FROM jn WHERE reason IS NOT NULL) + (SELECT count(*) FROM pr) AS c, (SELECT count(*) FROM x) AS d, (SELECT count(*) FROM fe) AS e, (SELECT count(*) FROM je WHERE reason IS NOT NULL) AS f)
SELECT unnest(['input_nodes', 'kept_nodes', 'rejected_nodes', 'merged_nodes', 'input_relationships', 'kept_relationships', 'rejected_relationships', 'merged_relationships', 'total_rejected_rows']) AS metric, unnest([a, b, c, a - b - c, d, e, f, d - e - f, c + f]) AS value FROM c"""
)
def qa_summary(spark, d):
    return qa.postprocess(judged_nodes(spark, d), judged_edges(spark, d), "Supplier").summary


@query(f"WITH {NODES_SQL} SELECT label, label IN ('Region', 'Nation', 'Customer', 'Supplier', 'Part') AND trim(name) <> '' AS ok, count(*) AS n FROM n GROUP BY ALL")
def qa_import_nodes(spark, d):
    return qa.import_nodes(dirty_nodes(spark, d), TRADE).groupBy("label", "ok").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL} SELECT rel_type, rel_type = 'SUPPLIES' AND src LIKE 'Supplier:%' AS ok, count(*) AS n, round(sum(coalesce(confidence, 0)), 2) AS total FROM je GROUP BY ALL")
def qa_import_edges(spark, d):
    rows = qa.import_edges(dirty_edges(spark, d), TRADE)
    return rows.groupBy("rel_type", "ok").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 2).alias("total"))


@query(f"WITH {NODES_SQL} SELECT label, name, count(*) AS n FROM n GROUP BY label, name HAVING count(*) > 1")
def qa_unique_check(spark, d):
    return qa.repeated_keys(dirty_nodes(spark, d), "label", "name")


@query(f"WITH {EDGES_SQL} SELECT rel_type, count(*) AS n FROM x WHERE NOT coalesce(src LIKE 'Part:%' AND try_cast(substr(src, 6) AS BIGINT) % 17 = 0, FALSE) AND NOT coalesce(dst LIKE 'Part:%' AND try_cast(substr(dst, 6) AS BIGINT) % 17 = 0, FALSE) GROUP BY rel_type")
def qa_clear(spark, d):
    nodes = dirty_nodes(spark, d).select("node_id", F.array("label").alias("labels"))
    _, left = qa.clear(nodes, dirty_edges(spark, d), ("Nothing",))
    return left.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, split_part(node_id, ':', 1) AS label, len(list_distinct(list_filter(regexp_split_to_array(ids, '[;,\\s]+'), lambda x: x <> ''))) AS n FROM (SELECT 'Part:' || p_partkey AS node_id, p_partkey || '; ' || (p_partkey % 7) || ',,' || p_partkey AS ids FROM part)")
def qa_split_ids(spark, d):
    k = F.col("p_partkey").cast("string")
    ids = F.concat(k, F.lit("; "), (F.col("p_partkey") % 7).cast("string"), F.lit(",,"), k)
    rows = load(spark, d, "part").select(F.concat(F.lit("Part:"), k).alias("node_id"), tx.split_ids(ids).alias("ids"))
    return rows.select("node_id", tx.label_of(F.col("node_id")).alias("label"), F.size("ids").cast("long").alias("n"))
