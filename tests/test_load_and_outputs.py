import pytest

from graphloom import api
from graphloom.operators import graph, load
from graphloom.operators import quality as qa
from graphloom.operators import users as us
from graphloom.plans import quality_queries as qq
from graphloom.schema import EDGE_COLUMNS, NODE_COLUMNS, REJECT_COLUMNS
from graphloom.sources import csv, markup

DATA = "/root/testdata/sf0.001"


def test_the_four_outputs(spark, tmp_path):
    out = qa.postprocess(qq.judged_nodes(spark, DATA), qq.judged_edges(spark, DATA), "Supplier")
    csv.write_outputs(out, str(tmp_path), single=True)
    nodes, edges = csv.read(spark, f"{tmp_path}/nodes", NODE_COLUMNS), csv.read(spark, f"{tmp_path}/relationships", EDGE_COLUMNS)
    rejects = csv.read(spark, f"{tmp_path}/rejects", {c: c for c in REJECT_COLUMNS})
    counts = {r.metric: int(r.value) for r in csv.read(spark, f"{tmp_path}/summary", {"metric": "metric", "value": "value"}).collect()}
    assert (nodes.count(), edges.count(), rejects.count()) == (counts["kept_nodes"], counts["kept_relationships"], counts["total_rejected_rows"])
    for kind, table in (("nodes", qq.dirty_nodes(spark, DATA)), ("relationships", qq.dirty_edges(spark, DATA))):
        assert counts[f"input_{kind}"] == table.count() == sum(counts[f"{p}_{kind}"] for p in ("kept", "rejected", "merged"))
    ids = {r.node_id for r in nodes.collect()}
    rows = edges.collect()
    assert all(r.src in ids and r.dst in ids for r in rows)
    keys = [(r.rel_type, r.src, r.dst, r.source_doc_id) for r in rows]
    assert keys == sorted(keys)


NODE = "label string, node_id string, name string, source_doc_ids string, description string, seq long"
EDGE = "src string, dst string, rel_type string, source_doc_id string, evidence string, confidence double, section string, seq long"


def test_load_twice(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "A:1", "one", "d", "", 1), ("A", "A:1", "two", "d", "", 2), ("B", "B:1", "b", "d", "", 3)], NODE)
    edges = spark.createDataFrame([("A:1", "B:1", "T", "d", "e1", 0.5, "", 1), ("A:1", "B:1", "T", "d", "e2", 0.4, "", 2), ("A:1", "C:1", "T", "d", "e", 0.5, "", 3)], EDGE)
    stored = load.load_graph(spark, nodes, edges, f"{tmp_path}/one")
    assert sorted((r.node_id, r.name) for r in stored[0].collect()) == [("A:1", "two"), ("B:1", "b")]
    assert [(r.src, r.dst, r.evidence) for r in stored[1].collect()] == [("A:1", "B:1", "e2")]
    more = spark.createDataFrame([("B", "B:1", "new", "d", "", 1), ("C", "C:1", "c", "d", "", 2)], NODE)
    again = load.load_graph(spark, more, edges.filter("dst = 'C:1'"), f"{tmp_path}/two", stored)
    assert sorted((r.node_id, r.name) for r in again[0].collect()) == [("A:1", "two"), ("B:1", "new"), ("C:1", "c")]
    assert sorted((r.src, r.dst) for r in again[1].collect()) == [("A:1", "B:1"), ("A:1", "C:1")]
    assert load.probe(spark)


def test_identifiers():
    assert load.identifier("Has_1") == "Has_1"
    for name in ("a b", "__", "", "x`y", "a-b"):
        with pytest.raises(ValueError):
            load.identifier(name)


PAGE = """<html><head><title>T - x</title><meta name="description" content=" meta &amp; text "></head><body><h1>Ti<b>tle</b></h1>{summary}
<dl><dt class="basicInfo-item name">Name：</dt><dd class="basicInfo-item value">v <a>1</a>[2]</dd><dt class="basicInfo-item name">Empty</dt><dd class="basicInfo-item value"> </dd></dl>
<p>before</p><h2 class="para-title">Head：</h2><div class="para">a <b>b</b></div><p>c</p><script>var p = "<p>no</p>"</script><h3>None</h3><div class="box-title x">Last</div><p>d</p>
<img src="data:x"><img data-src="//h/a.png" src="b"><img src="/c.png"><img src="/c.png"></body></html>"""


def test_pages_to_documents(spark):
    rows = [("k1", PAGE.format(summary='<div class="lemma-summary x"><p>sum</p><p>mary</p></div>'), "http://s/p/q"), ("k2", PAGE.format(summary="").replace("<h1>Ti<b>tle</b></h1>", ""), None), ("k3", PAGE + "seccaptcha", None), ("k4", None, None), ("k5", "", "u")]
    frame = spark.createDataFrame(rows, "k string, html string, url string")
    from pyspark.sql import functions as F

    got = {r.k: r.d for r in frame.select("k", markup.document(F.col("k"), F.coalesce("html", F.lit("")), F.col("url"), "-").alias("d")).collect()}
    one, two = got["k1"], got["k2"]
    assert (one.title, one.summary, one.basic_info) == ("Title", "sum\nmary", {"Name": "v1"})
    assert [tuple(s) for s in one.sections] == [("-", "before"), ("Head", "a\nb\nc"), ("Last", "d")]
    assert one.images == ["https://h/a.png", "http://s/c.png"]
    assert (two.title, two.summary) == ("k2", "meta & text")
    assert got["k3"] is None and got["k4"].sections == [] and got["k5"].title == "k5"
    urls = frame.select(markup.quoted(F.lit("高 x/")).alias("q"), markup.joined_url(F.lit("http://a/b/c"), F.lit("../d")).alias("j")).first()
    assert (urls.q, urls.j) == ("%E9%AB%98%20x/", "http://a/d")


def test_service_calls(spark):
    users = spark.createDataFrame([("u", "h", "s", "r")], "username string, password_hash string, salt string, role string")
    fresh, own, outcome = api.register_user(users, " new ", "pw", "role", ["a", "b", "c", "d"])
    assert [r.username for r in fresh.collect()] == ["new"] and [r.preference for r in own.orderBy("id").collect()] == ["a", "b", "c"]
    assert outcome.first().success and not api.register_user(users, "u", "pw", "role")[2].first().success
    found = api.login_user(users.unionByName(fresh.select(*users.columns)), own, "new", "pw").first()
    assert (found.role, found.preferences) == ("role", ["a", "b", "c"])
    assert api.answer(api.register_user, users, "", "pw", "role") == {"code": 400, "message": "username is missing", "data": None}
    assert api.answer(api.register_user, users, "x", "pw", "role", "abc")["code"] == 400
    assert api.answer(lambda: 1) == {"code": 200, "message": "success", "data": 1}


def test_tables_of_users(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS people LOCATION '{tmp_path}/people'")
    us.create_tables(spark, "people")
    us.create_tables(spark, "people")
    assert spark.table("people.users").count() == 0 and spark.table("people.user_preferences").columns == ["username", "id", "preference"]
    spark.sql("DROP DATABASE people CASCADE")


def test_large_frontiers_are_joined(spark, monkeypatch):
    n = 60
    vertices = spark.range(n).selectExpr("concat('n', id) as node_id", "concat('name', id) as name", "'A' as label", "0 as category", "'' as description")
    edges = spark.range(n).selectExpr("concat('e', id) as edge_id", "concat('n', id % 6) as src", "concat('n', id) as dst", "'T' as rel_type", "'' as source_doc_id", "'' as evidence", "1.0D as confidence", "'' as section")
    run = lambda: sorted(map(tuple, graph.multi_hop(vertices, edges, ("A",), "name1", 3).collect()))
    expected = run()
    monkeypatch.setattr(graph, "FRONTIER", 1)
    assert run() == expected and len(expected) > 20
