"""Graph queries on the trade graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph
from graphloom.plans.registry import query
from graphloom.plans.trade import GRAPH_SQL, edges, edges_at, vertices
from graphloom.schema import TRADE

L = TRADE.labels
NATION, CUSTOMER, SUPPLIER = "NATION_3", "Customer#000000007", "Supplier#000000004"


@query(f"{GRAPH_SQL} SELECT node_id, name, label FROM v")
def kg_nodes(spark, d):
    return graph.labelled(vertices(spark, d), L).select("node_id", "name", "label")


@query(f"{GRAPH_SQL} SELECT edge_id, src, dst, rel_type, source_doc_id, evidence, confidence, section FROM e")
def kg_edges(spark, d):
    return edges(spark, d)


@query(f"{GRAPH_SQL} SELECT label || ':' || sha1(label || ':' || name) AS stable, count(*) AS n FROM v GROUP BY label, name")
def kg_stable_ids(spark, d):
    return vertices(spark, d).groupBy(tx.stable_id(F.col("label"), F.col("name")).alias("stable")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{GRAPH_SQL} SELECT name, category FROM v WHERE contains(name, '01') ORDER BY name, node_id LIMIT 20")
def kg_suggest(spark, d):
    return graph.suggest(vertices(spark, d), L, "01")


@query(f"{GRAPH_SQL} SELECT name, category FROM v WHERE contains(name, 'ring') AND category = 4 ORDER BY name, node_id LIMIT 20")
def kg_suggest_category(spark, d):
    return graph.suggest(vertices(spark, d), L, "ring", 4)


@query(f"{GRAPH_SQL} SELECT count(*) > 0 AS found FROM v WHERE name = '{NATION}'")
def kg_exists(spark, d):
    return graph.exists(vertices(spark, d), NATION)


@query(f"{GRAPH_SQL} SELECT label, count(*) AS n FROM v GROUP BY label")
def kg_stats_by_label(spark, d):
    return graph.stats_by_label(vertices(spark, d), L)


@query(f"{GRAPH_SQL} SELECT rel_type, count(*) AS n FROM e GROUP BY rel_type")
def kg_stats_by_type(spark, d):
    return graph.stats_by_type(edges(spark, d))


def hop_sql(name: str, where: str = "TRUE", limit: int = graph.ROWS_ONE_HOP) -> str:
    return f"""{GRAPH_SQL}, c AS (SELECT * FROM v WHERE name = '{name}' ORDER BY category, node_id LIMIT 1),
h AS (SELECT d.edge_id, n.node_id AS other, n.name AS neighbor FROM c JOIN d ON d.a = c.node_id JOIN v n ON n.node_id = d.b WHERE {where} ORDER BY neighbor, d.edge_id LIMIT {limit}),
hn AS (SELECT * FROM v WHERE node_id IN (SELECT other FROM h UNION SELECT node_id FROM c)),
he AS (SELECT * FROM e WHERE edge_id IN (SELECT edge_id FROM h))"""


COLOR_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRADE.colors.items()) + " ELSE '#999999' END"
NODE_SQL = f"SELECT name AS id, name AS caption, label AS node_type, {COLOR_SQL} AS color, coalesce(description, '') AS description FROM hn"
EDGE_SQL = "SELECT edge_id, 'rel_' || rel_type || '_' || f.name || '_' || t.name AS id, f.name AS \"from\", t.name AS \"to\", rel_type AS caption FROM he JOIN v f ON f.node_id = src JOIN v t ON t.node_id = dst"


def _hood(spark, d, name, **more):
    v, e = vertices(spark, d), edges(spark, d)
    return v, e, graph.small(graph.one_hop(v, e, L, name, **more), graph.ROWS_ONE_HOP + 1)


@query(f"{hop_sql(NATION)} {NODE_SQL}")
def kg_1hop_nodes(spark, d):
    v, e, rows = _hood(spark, d, NATION)
    return graph.display_nodes(graph.nodes_of(rows, v, L, NATION, "other"), TRADE.colors, TRADE.default_color)


@query(f"{hop_sql(NATION)} {EDGE_SQL}")
def kg_1hop_rels(spark, d):
    v, e, rows = _hood(spark, d, NATION)
    return graph.display_edges(graph.edges_of(rows, e), v)


@query(f"{hop_sql(SUPPLIER, 'n.category = 4')} {NODE_SQL}")
def kg_1hop_category(spark, d):
    v, e, rows = _hood(spark, d, SUPPLIER, category=4)
    return graph.display_nodes(graph.nodes_of(rows, v, L, SUPPLIER, "other"), TRADE.colors, TRADE.default_color)


EXCLUDED = ("NATION_0", "red widget", "small ring")


@query(f"{hop_sql(SUPPLIER, 'n.name NOT IN (' + ', '.join(repr(x) for x in EXCLUDED) + ')')} {NODE_SQL}")
def kg_expand(spark, d):
    v, e, rows = _hood(spark, d, SUPPLIER, exclude=EXCLUDED)
    return graph.display_nodes(graph.nodes_of(rows, v, L, SUPPLIER, "other"), TRADE.colors, TRADE.default_color)


def size_sql() -> str:
    return """, g AS (SELECT hn.node_id, hn.name, (SELECT count(*) FROM he WHERE he.src = hn.node_id) + (SELECT count(*) FROM he WHERE he.dst = hn.node_id) AS degree FROM hn),
s AS (SELECT coalesce(min(CASE WHEN degree > 0 THEN degree END), 1) AS lo, coalesce(max(CASE WHEN degree > 0 THEN degree END), 1) AS hi FROM g)
SELECT node_id, name, CAST(degree AS BIGINT) AS degree, CAST(CASE WHEN hi = lo THEN 40 ELSE round_even(20 + (degree - lo) / (hi - lo) * 40.0, 0) END AS INTEGER) AS size FROM g, s"""


@query(hop_sql(CUSTOMER) + size_sql())
def kg_degree_size(spark, d):
    v, e, rows = _hood(spark, d, CUSTOMER)
    return graph.degree_sizes(graph.nodes_of(rows, v, L, CUSTOMER, "other"), graph.edges_of(rows, e))


def paths_sql(name: str, depth: int, where: str = "TRUE") -> str:
    steps = [f"p{k} AS (SELECT d.b AS node, list_append(p.path, d.edge_id) AS path, {k} AS hop FROM p{k - 1} p JOIN d ON d.a = p.node WHERE NOT list_contains(p.path, d.edge_id))" for k in range(1, depth + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, depth + 1))
    return f"""{GRAPH_SQL}, c AS (SELECT * FROM v WHERE name = '{name}' ORDER BY category, node_id LIMIT 1),
p0 AS (SELECT node_id AS node, CAST([] AS VARCHAR[]) AS path, 0 AS hop FROM c), {", ".join(steps)},
ends AS (SELECT x.node, x.path, x.hop, n.name AS end_name, array_to_string(x.path, '/') AS path_id FROM ({every}) x JOIN v n ON n.node_id = x.node WHERE {where}),
least AS (SELECT * FROM ends ORDER BY hop, end_name, path_id LIMIT {graph.ROWS_MULTI_HOP}),
h AS (SELECT node AS other, hop, end_name, path_id, unnest(path) AS edge_id, generate_subscripts(path, 1) AS pos FROM least),
k AS (SELECT * FROM h ORDER BY hop, end_name, path_id, pos LIMIT {graph.ROWS_MULTI_HOP}),
hn AS (SELECT * FROM v WHERE node_id IN (SELECT other FROM k UNION SELECT node_id FROM c)),
he AS (SELECT * FROM e WHERE edge_id IN (SELECT edge_id FROM k))"""


def _paths(spark, d, name, depth, category=None):
    v, e = vertices(spark, d), edges(spark, d)
    return v, e, graph.multi_hop(v, e, L, name, depth, category, at=edges_at(spark, d))


def _drawn(spark, d, v, e, rows):
    """The edges of a limited neighbourhood, so few that their ends' names are found without a shuffle."""
    return graph.display_edges(graph.small(graph.edges_of(rows, e, edges_at(spark, d)), graph.ROWS_MULTI_HOP), v)


@query(f"{paths_sql('AFRICA', 2)} {NODE_SQL}")
def kg_multihop2_nodes(spark, d):
    v, e, rows = _paths(spark, d, "AFRICA", 2)
    return graph.display_nodes(graph.nodes_of(rows, v, L, "AFRICA", "node"), TRADE.colors, TRADE.default_color)


@query(f"{paths_sql(CUSTOMER, 2, 'n.category = 4')} {EDGE_SQL}")
def kg_multihop2_category(spark, d):
    return _drawn(spark, d, *_paths(spark, d, CUSTOMER, 2, 4))


@query(f"{paths_sql('AFRICA', 3, 'n.category = 3')} {EDGE_SQL}")
def kg_multihop3_rels(spark, d):
    return _drawn(spark, d, *_paths(spark, d, "AFRICA", 3, 3))


@query(f"{GRAPH_SQL} SELECT p.name FROM v s JOIN e ON e.src = s.node_id JOIN v p ON p.node_id = e.dst WHERE s.name = '{SUPPLIER}' AND s.label = 'Supplier' AND p.label = 'Part' AND e.rel_type = 'SUPPLIES'")
def kg_typed_lookup(spark, d):
    return graph.typed_lookup(vertices(spark, d), edges(spark, d), "SUPPLIES", SUPPLIER, "Supplier", "Part")


@query(f"{GRAPH_SQL} SELECT s.name FROM v s JOIN e ON e.src = s.node_id JOIN v p ON p.node_id = e.dst WHERE p.name = 'small ring' AND s.label = 'Supplier' AND p.label = 'Part' AND e.rel_type = 'SUPPLIES'")
def kg_typed_lookup_rev(spark, d):
    return graph.typed_lookup(vertices(spark, d), edges(spark, d), "SUPPLIES", "small ring", "Supplier", "Part", reverse=True)


@query(
    f"""{GRAPH_SQL}, c AS (SELECT * FROM v WHERE name = '{NATION}' AND label = 'Nation'),
x AS (SELECT c.node_id, e.rel_type, t.name FROM c JOIN e ON e.src = c.node_id JOIN v t ON t.node_id = e.dst
 UNION ALL SELECT c.node_id, e.rel_type, f.name FROM c JOIN e ON e.dst = c.node_id JOIN v f ON f.node_id = e.src)
SELECT c.name AS center, coalesce(array_to_string(list_sort(list_distinct(list(x.name) FILTER (x.rel_type = 'LIVES_IN'))), ';'), '') AS customers,
 coalesce(array_to_string(list_sort(list_distinct(list(x.name) FILTER (x.rel_type = 'BASED_IN'))), ';'), '') AS suppliers,
 coalesce(array_to_string(list_sort(list_distinct(list(x.name) FILTER (x.rel_type = 'IN_REGION'))), ';'), '') AS region FROM c LEFT JOIN x USING (node_id) GROUP BY c.node_id, c.name"""
)
def kg_full_info(spark, d):
    wanted = {"customers": ("LIVES_IN", "in"), "suppliers": ("BASED_IN", "in"), "region": ("IN_REGION", "out")}
    return graph.full_info(vertices(spark, d), edges(spark, d), NATION, "Nation", wanted)


def joined_sql(types: tuple[str, ...]) -> str:
    listed = ", ".join(repr(t) for t in types)
    return f"(SELECT coalesce(string_agg(n.name, '；' ORDER BY n.name), '') FROM c JOIN d ON d.a = c.node_id JOIN v n ON n.node_id = d.b WHERE d.rel_type IN ({listed}))"


@query(f"{GRAPH_SQL}, c AS (SELECT * FROM v WHERE name = '{SUPPLIER}' ORDER BY category, node_id LIMIT 1) SELECT {joined_sql(('BASED_IN', 'SUPPLIES'))} AS joined")
def kg_agg_relation(spark, d):
    return graph.aggregated_relation(vertices(spark, d), edges(spark, d), L, SUPPLIER, ("BASED_IN", "SUPPLIES"))


@query(f"{GRAPH_SQL}, c AS (SELECT * FROM v WHERE name = '{CUSTOMER}' ORDER BY category, node_id LIMIT 1) SELECT name, category, coalesce(description, '') AS definition, {joined_sql(('BOUGHT',))} AS indications, {joined_sql(('LIVES_IN', 'IN_REGION'))} AS bad_reactions FROM c")
def kg_detail(spark, d):
    return graph.entity_detail(vertices(spark, d), edges(spark, d), L, CUSTOMER, ("BOUGHT",), ("LIVES_IN", "IN_REGION"))
