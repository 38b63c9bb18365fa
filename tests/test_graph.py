import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, view
from graphloom.operators.merge import best_edges, latest, merge_nodes

LABELS = ("A", "B")


@pytest.fixture(scope="module")
def small(spark):
    v = spark.createDataFrame([("a1", "x", "A", 0, "d"), ("a2", "y", "A", 0, None), ("b1", "z", "B", 1, ""), ("b2", "x", "B", 1, ""), ("b3", "lone", "B", 1, "")], "node_id string, name string, label string, category int, description string")
    e = spark.createDataFrame([("e1", "a1", "a2", "T"), ("e2", "a1", "b1", "T"), ("e3", "a2", "b1", "U"), ("e4", "a1", "b1", "T")], "edge_id string, src string, dst string, rel_type string")
    return v, e


def test_one_hop_keeps_a_lone_centre(small):
    v, e = small
    rows = graph.one_hop(v, e, LABELS, "lone").collect()
    assert [(r.node, r.edge_id) for r in rows] == [("b3", None)]
    assert graph.nodes_of(graph.one_hop(v, e, LABELS, "lone"), v, LABELS, "lone", "other").count() == 1
    assert graph.one_hop(v, e, LABELS, "nobody").count() == 0


def test_homonyms_take_the_least_category(small):
    v, e = small
    assert {r.node for r in graph.one_hop(v, e, LABELS, "x").collect()} == {"a1"}


def test_paths_use_no_edge_twice(small):
    v, e = small
    rows = graph.multi_hop(v, e, LABELS, "x", 9).collect()  # depth is cut to 3
    assert max(r.hop for r in rows) == 3
    for path in {r.path_id for r in rows}:
        parts = path.split("/")
        assert len(parts) == len(set(parts))
    limited = graph.multi_hop(v, e, LABELS, "x", 3, limit=4)
    assert limited.count() == 4


@pytest.mark.parametrize("degrees, sizes", [((3, 1, 2), (60, 20, 40)), ((17, 2, 1), (60, 22, 20)), ((2, 2, 2), (40, 40, 40)), ((5, 1, 0), (60, 20, 10))])
def test_sizes(spark, degrees, sizes):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(len(degrees))], "node_id string, name string")
    edges = spark.createDataFrame([(f"n{i}", "outside") for i, d in enumerate(degrees) for _ in range(d)], "src string, dst string")
    got = {r.node_id: r["size"] for r in graph.degree_sizes(nodes, edges).collect()}
    assert tuple(got[f"n{i}"] for i in range(len(degrees))) == sizes


def test_diverse_top_k(spark):
    nodes = spark.createDataFrame([(0, 60, 0), (1, 50, 1), (1, 40, 2), (1, 30, 3), (2, 45, 4)], "category int, size int, pos int")
    assert [(r["size"], r.category) for r in view.diverse_top_k(nodes, 4).collect()] == [(60, 0), (50, 1), (45, 2), (40, 1)]


def test_merging(spark):
    e = spark.createDataFrame([("a", "b", "T", "d", "late", 0.9, "s"), ("a", "b", "T", "d", "early", 0.9, "s"), ("a", "b", "T", "d", "x", 0.1, "s")], "src string, dst string, rel_type string, source_doc_id string, evidence string, confidence double, section string")
    assert [r.evidence for r in best_edges(e).collect()] == ["early"]
    n = spark.createDataFrame([("i", "n", "L", ["b"], "", 1), ("i", "n", "L", ["a", "b"], "xx", 2), ("i", "n", "L", ["c"], "yyy", 3)], "node_id string, name string, label string, docs array<string>, description string, seq int")
    assert [(r.docs, r.description) for r in merge_nodes(n, longest=False).collect()] == [(["a", "b", "c"], "xx")]
    assert merge_nodes(n, longest=True).first().description == "yyy"
    assert latest(spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "a")], "k int, t int, v string"), ("k",), "t").first().v == "b"


def test_one_hop_plan_broadcasts_only_the_centre(small):
    v, e = small
    plan = graph.one_hop(v, e, LABELS, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("LocalLimit") >= 1
    assert graph.suggest(v, LABELS, "x").orderBy(F.col("name")).count() == 2
