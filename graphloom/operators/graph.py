"""Queries over a property graph: vertices(node_id, name, label, category, description) and
edges(edge_id, src, dst, rel_type, source_doc_id, evidence, confidence, section).

The edges are never doubled as a whole: each direction is scanned for the nodes wanted. A centre or a frontier
of up to ``FRONTIER`` nodes is brought to the driver and becomes a filter on literals, which Catalyst moves below
a deduplication of the edges and to their scans; a larger frontier stays a plan and is semi-joined. The rows of a
limited neighbourhood (at most ``ROWS_MULTI_HOP``) can be brought to the driver by ``small``, once for all their uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_ONE_HOP = 200
ROWS_MULTI_HOP = 300
MAX_DEPTH = 3
SUGGESTIONS = 20
#: Nodes that may travel by way of the driver.
FRONTIER = 5_000
#: Reads the edges whose column ("src" or "dst") is among some ids: for a source that can do better than a filter.
EdgesAt = Callable[[str, list[str]], DataFrame]


def labelled(vertices: DataFrame, labels: tuple[str, ...], category: int | None = None) -> DataFrame:
    """Vertices with one of the labels, or with that of the category."""
    if category is None:
        return vertices.filter(F.col("label").isin(*labels))
    if not 0 <= category < len(labels):
        raise ValueError(f"category {category} is not in 0..{len(labels) - 1}")
    return vertices.filter(F.col("label") == labels[category])


def suggest(vertices: DataFrame, labels: tuple[str, ...], keyword: str, category: int | None = None, limit: int = SUGGESTIONS) -> DataFrame:
    """Names that contain the keyword, case-sensitive, in order of name; homonyms repeat."""
    found = labelled(vertices, labels, category).filter(F.contains("name", F.lit(keyword)))
    return found.select("name", "category", "node_id").orderBy("name", "node_id").limit(limit).select("name", "category")


def exists(vertices: DataFrame, name: str) -> DataFrame:
    return vertices.filter(F.col("name") == name).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def centre(vertices: DataFrame, labels: tuple[str, ...], name: str) -> DataFrame:
    """The entity of that name; of homonyms the one with the least category, then node id."""
    return labelled(vertices.filter(F.col("name") == name), labels).orderBy("category", "node_id").limit(1)


def small(frame: DataFrame, limit: int) -> DataFrame:
    """``frame`` as literal rows if it has at most ``limit`` of them; else as it is."""
    rows = frame.limit(limit + 1).toArrow()
    return frame.sparkSession.createDataFrame(rows) if rows.num_rows <= limit else frame


def touching(edges: DataFrame, column: str, nodes: DataFrame, at: EdgesAt | None = None) -> DataFrame:
    """Edges whose ``column`` is among ``nodes`` (node, ...); few nodes are looked up by ``at`` where it is given."""
    wanted = nodes.select("node").distinct()
    ids = [r.node for r in wanted.limit(FRONTIER + 1).collect()]
    if len(ids) <= FRONTIER:
        return edges.filter(F.col(column).isin(ids)) if at is None else at(column, ids).select(*edges.columns)
    return edges.join(wanted.withColumnRenamed("node", column), column, "left_semi")


def incident(edges: DataFrame, frontier: DataFrame, at: EdgesAt | None = None) -> DataFrame:
    """Edges at the nodes of ``frontier`` (node, ...): its columns, the edge and the node at the other end.

    Two joins, one per direction, so that each can use the small side and its filters. A loop counts once.
    """
    out = frontier.join(touching(edges, "src", frontier, at), F.col("node") == F.col("src")).withColumn("other", F.col("dst"))
    back = frontier.join(touching(edges, "dst", frontier, at).filter("src != dst"), F.col("node") == F.col("dst")).withColumn("other", F.col("src"))
    return out.unionByName(back)


def one_hop(vertices: DataFrame, edges: DataFrame, labels: tuple[str, ...], name: str, category: int | None = None, exclude: tuple[str, ...] = (), limit: int = ROWS_ONE_HOP) -> DataFrame:
    """Rows (centre, edge, neighbour) of the neighbourhood, the first ``limit`` by neighbour name and edge id.

    The filters stand on the neighbour's side of an outer join, so a centre without neighbours stays as one
    row with null edge.
    """
    start = small(centre(vertices, labels, name).select(F.col("node_id").alias("node")), 1)
    # an empty list is replaced by one empty name, as the request does
    near = labelled(vertices, labels, category).filter(~F.col("name").isin(*(exclude or ("",))))
    links = incident(edges, start).join(near.select(F.col("node_id").alias("other"), F.col("name").alias("neighbor")), "other")
    links = links.select("node", "edge_id", "src", "dst", "rel_type", "other", "neighbor").orderBy("neighbor", "edge_id").limit(limit)
    return start.join(links, "node", "left")


def multi_hop(vertices: DataFrame, edges: DataFrame, labels: tuple[str, ...], name: str, depth: int, category: int | None = None, limit: int = ROWS_MULTI_HOP, at: EdgesAt | None = None) -> DataFrame:
    """Rows (end node of a path, edge of the path) over undirected paths of 1 to ``depth`` edges that use no
    edge twice; the category holds for the end node only. The first ``limit`` by hop, end name, path and edge.

    Shorter paths come first, so the search ends at the hop that fills the limit.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    start = small(centre(vertices, labels, name).select(F.col("node_id").alias("node")), 1)
    paths = start.select("node", F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("tails"))
    wanted = labelled(vertices, labels, category).select(F.col("node_id").alias("node"), F.col("name").alias("end_name"))
    slim = edges.select("edge_id", "src", "dst")
    order = ("hop", "end_name", "path_id")
    least: DataFrame | None = None
    for hop in range(1, depth + 1):
        # all paths to a node go on by the same edges: these are looked up once per node
        nodes = small(paths.select("node").distinct(), FRONTIER)
        steps = incident(slim, nodes, at).select("node", "edge_id", "src", "other")
        paths = paths.join(steps, "node").filter(~F.array_contains("path", F.col("edge_id")))
        paths = paths.select(F.col("other").alias("node"), F.concat("path", F.array("edge_id")).alias("path"), F.concat("tails", F.array("src")).alias("tails"))
        if hop < depth:
            paths = small(paths, FRONTIER)  # the next hop reads them several times
        ends = paths.join(wanted, "node").select("node", "path", "tails", F.lit(hop).alias("hop"), "end_name", F.concat_ws("/", "path").alias("path_id"))
        # a path has a row for each of its edges; the least paths cover the limit, so only they are taken apart
        own = small(ends.orderBy(*order).limit(limit), limit)
        least = own if least is None else least.unionByName(own)
        if least.count() >= limit:
            break
    rows = least.orderBy(*order).limit(limit).select("node", "hop", "end_name", "path_id", "tails", F.posexplode("path").alias("at", "edge_id"))
    rows = rows.select("node", "hop", "end_name", "path_id", "at", "edge_id", F.get("tails", F.col("at")).alias("src"))
    return small(rows.orderBy(*order, "at").limit(limit), limit)


def nodes_of(rows: DataFrame, vertices: DataFrame, labels: tuple[str, ...], name: str, column: str) -> DataFrame:
    """Distinct nodes of a neighbourhood: the ends and the centre."""
    ids = rows.select(F.col(column).alias("node_id")).filter("node_id is not null").union(centre(vertices, labels, name).select("node_id")).distinct()
    ids = small(ids, FRONTIER)
    return vertices.join(ids, "node_id", "left_semi")


def edges_of(rows: DataFrame, edges: DataFrame, at: EdgesAt | None = None) -> DataFrame:
    """The edges of a neighbourhood. Edge ids say nothing of where an edge is stored, so rows with both ends narrow the scan."""
    ids = rows.select("edge_id").filter("edge_id is not null").distinct()
    if "src" in rows.columns:
        edges = touching(edges, "src", rows.select(F.col("src").alias("node")).filter("node is not null"), at)
    return edges.join(ids, "edge_id", "left_semi")


def display_nodes(nodes: DataFrame, colors: dict[str, str], default: str) -> DataFrame:
    color = F.lit(default)
    for label, value in reversed(colors.items()):
        color = F.when(F.col("label") == label, value).otherwise(color)
    return nodes.select(F.col("name").alias("id"), F.col("name").alias("caption"), F.col("label").alias("node_type"), color.alias("color"), F.coalesce("description", F.lit("")).alias("description"))


def display_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    names = vertices.select("node_id", "name")
    ends = edges.join(names.select(F.col("node_id").alias("src"), F.col("name").alias("from")), "src").join(names.select(F.col("node_id").alias("dst"), F.col("name").alias("to")), "dst")
    return ends.select("edge_id", F.concat(F.lit("rel_"), "rel_type", F.lit("_"), "from", F.lit("_"), "to").alias("id"), "from", "to", F.col("rel_type").alias("caption"))


def degree_sizes(nodes: DataFrame, edges: DataFrame, low: int = 20, span: int = 40) -> DataFrame:
    """Size of each node (node_id) by its degree among ``edges`` (src, dst): both ends count where they are nodes.

    The scale runs over the positive degrees, so a node without edges can fall below ``low``. Halves round
    to even.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))
    degrees = nodes.select("node_id", "name").join(ends, "node_id", "left").select("node_id", "name", F.coalesce("d", F.lit(0)).alias("degree"))
    scale = degrees.agg(F.coalesce(F.min(F.when(F.col("degree") > 0, F.col("degree"))), F.lit(1)).alias("lo"), F.coalesce(F.max(F.when(F.col("degree") > 0, F.col("degree"))), F.lit(1)).alias("hi"))
    size = F.when(F.col("hi") == F.col("lo"), F.lit(40.0)).otherwise(F.bround(low + (F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo")) * span))
    return degrees.crossJoin(F.broadcast(scale)).select("node_id", "name", "degree", size.cast("int").alias("size"))  # one row


def typed_lookup(vertices: DataFrame, edges: DataFrame, rel_type: str, name: str, from_label: str, to_label: str, reverse: bool = False) -> DataFrame:
    """Names at the far end of directed edges of one type; duplicates stay."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    start = vertices.filter((F.col("name") == name) & (F.col("label") == (to_label if reverse else from_label))).select(F.col("node_id").alias(here))
    far = vertices.filter(F.col("label") == (from_label if reverse else to_label)).select(F.col("node_id").alias(there), F.col("name").alias("found"))
    near = touching(edges.filter(F.col("rel_type") == rel_type), here, start.select(F.col(here).alias("node")))
    return near.join(start, here).join(far, there).select(F.col("found").alias("name"))


def full_info(vertices: DataFrame, edges: DataFrame, name: str, label: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per entity of that name and label: for each output column the sorted distinct names over its
    (relation type, direction). One pass over the edges, so the branches don't multiply.
    """
    start = small(vertices.filter((F.col("name") == name) & (F.col("label") == label)).select(F.col("node_id").alias("node"), F.col("name").alias("center")), FRONTIER)
    types = [t for t, _ in wanted.values()]
    slim = edges.filter(F.col("rel_type").isin(*types)).select("edge_id", "src", "dst", "rel_type")
    leaving, entering = touching(slim, "src", start), touching(slim, "dst", start)
    out = start.join(leaving, F.col("node") == F.col("src")).select("node", "rel_type", F.lit("out").alias("way"), F.col("dst").alias("other"))
    back = start.join(entering, F.col("node") == F.col("dst")).select("node", "rel_type", F.lit("in").alias("way"), F.col("src").alias("other"))
    found = out.union(back).join(vertices.select(F.col("node_id").alias("other"), F.col("name").alias("found")), "other")
    pick = lambda t, way: F.when((F.col("rel_type") == t) & (F.col("way") == way), F.col("found"))
    whole = start.join(found.select("node", "rel_type", "way", "found"), "node", "left").groupBy("node", "center")
    return whole.agg(*[F.concat_ws(";", F.array_sort(F.collect_set(pick(t, way)))).alias(c) for c, (t, way) in wanted.items()]).drop("node")


def aggregated_relation(vertices: DataFrame, edges: DataFrame, labels: tuple[str, ...], name: str, types: tuple[str, ...], separator: str = "；") -> DataFrame:
    """Names of all neighbours over the relation types in either direction, joined in order; duplicates stay; empty if none."""
    start = small(centre(vertices, labels, name).select(F.col("node_id").alias("node")), 1)
    slim = edges.filter(F.col("rel_type").isin(*types)).select("edge_id", "src", "dst")
    found = incident(slim, start).join(labelled(vertices, labels).select(F.col("node_id").alias("other"), "name"), "other")
    return found.agg(F.concat_ws(separator, F.array_sort(F.collect_list("name"))).alias("joined"))


def entity_detail(vertices: DataFrame, edges: DataFrame, labels: tuple[str, ...], name: str, indications: tuple[str, ...], reactions: tuple[str, ...]) -> DataFrame:
    """One row: name, category, definition and two joined neighbour lists; no row for an unknown name."""
    entity = centre(vertices, labels, name).select("name", "category", F.coalesce("description", F.lit("")).alias("definition"))
    first = aggregated_relation(vertices, edges, labels, name, indications).withColumnRenamed("joined", "indications")
    second = aggregated_relation(vertices, edges, labels, name, reactions).withColumnRenamed("joined", "bad_reactions")
    return entity.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))  # one row each


def stats_by_label(vertices: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Count of each label, zeros included."""
    wanted = vertices.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = vertices.filter(F.col("label").isin(*labels)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def stats_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
