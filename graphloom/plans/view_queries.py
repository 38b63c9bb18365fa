"""Viewer and user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import users as us
from graphloom.operators import view
from graphloom.plans.registry import query
from graphloom.plans.trade import load
from graphloom.schema import TRADE

# customers of the first nations as nodes, their orders' parts as links
NODES_SQL = "nodes AS (SELECT c_name AS name, c_nationkey % 5 AS category, CAST(c_acctbal AS BIGINT) AS size, c_custkey AS pos FROM customer)"
LINKS_SQL = "links AS (SELECT o_orderkey AS link_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS source, 'Customer#' || lpad(CAST((o_orderkey * 7) % 1500 AS VARCHAR), 9, '0') AS target, o_orderstatus AS caption FROM orders)"


def nodes(spark, d):
    return load(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 5).alias("category"), F.round("c_acctbal").cast("long").alias("size"), F.col("c_custkey").alias("pos"))


def links(spark, d):
    name = lambda c: F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("link_id"), name(F.col("o_custkey")).alias("source"), name(F.col("o_orderkey") * 7 % 1500).alias("target"), F.col("o_orderstatus").alias("caption"))


TOP_SQL = "top AS (SELECT name, category, size, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, pos) AS turn FROM nodes) ORDER BY turn, category LIMIT 10)"


@query(f"WITH {NODES_SQL}, {TOP_SQL} SELECT name, category, size FROM top")
def view_diverse_top10(spark, d):
    return view.diverse_top_k(nodes(spark, d), 10).select("name", "category", "size")


def shown(spark, d):
    return nodes(spark, d).filter("pos % 10 = 0")


@query(f"WITH {NODES_SQL}, {LINKS_SQL}, s AS (SELECT name FROM nodes WHERE pos % 10 = 0) SELECT link_id, source, target FROM links WHERE source IN (FROM s) AND target IN (FROM s)")
def view_links_both(spark, d):
    return view.links_both(links(spark, d), shown(spark, d)).select("link_id", "source", "target")


@query(f"WITH {NODES_SQL}, {LINKS_SQL}, s AS (SELECT name FROM nodes WHERE pos % 10 = 0) SELECT link_id, source, target FROM links WHERE source IN (FROM s) OR target IN (FROM s)")
def view_links_either(spark, d):
    return view.links_either(links(spark, d), shown(spark, d)).select("link_id", "source", "target")


PARENT, CLICKED = "Customer#000000001", "Customer#000000007"


@query(f"WITH {NODES_SQL}, {LINKS_SQL} SELECT name FROM nodes WHERE name IN ('{PARENT}', '{CLICKED}') OR name IN (SELECT target FROM links WHERE source = '{CLICKED}') OR name IN (SELECT source FROM links WHERE target = '{CLICKED}')")
def view_trim(spark, d):
    return view.trim(nodes(spark, d), links(spark, d), PARENT, CLICKED).select("name")


@query(f"WITH {NODES_SQL} SELECT name, category FROM nodes WHERE pos % 10 = 0 UNION ALL SELECT name, category FROM nodes WHERE pos % 15 = 0 AND pos % 10 <> 0")
def view_merge(spark, d):
    old, fresh = shown(spark, d), nodes(spark, d).filter("pos % 15 = 0")
    return old.unionByName(view.new_nodes(fresh, old)).select("name", "category")


@query(f"WITH {NODES_SQL} SELECT name FROM nodes WHERE pos % 15 = 0 AND pos % 10 <> 0")
def view_new_nodes(spark, d):
    return view.new_nodes(nodes(spark, d).filter("pos % 15 = 0"), shown(spark, d)).select("name")


@query(f"WITH {LINKS_SQL} SELECT shown, count(*) AS n FROM (SELECT CASE caption WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE coalesce(caption, '') END AS shown FROM links) GROUP BY shown")
def view_caption_map(spark, d):
    return view.captions(links(spark, d), {"F": "filled", "O": "open"}).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(i AS INTEGER) AS category, coalesce(['Region', 'Nation', 'Customer', 'Supplier', 'Part'][i + 1], 'category ' || i) AS name FROM (SELECT unnest(range(greatest(8, 1 + (SELECT max(c_nationkey % 11) FROM customer)))) AS i)")
def view_categories(spark, d):
    return view.categories(load(spark, d, "customer").select((F.col("c_nationkey") % 11).alias("category")), TRADE.labels)


@query("SELECT CAST(i AS INTEGER) AS category, coalesce(['Region', 'Nation', 'Customer', 'Supplier', 'Part'][i + 1], 'category ' || i) AS name FROM (SELECT unnest(range(greatest(8, 1 + (SELECT max(c_nationkey % 3) FROM customer)))) AS i)")
def view_categories_least(spark, d):
    return view.categories(load(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("category")), TRADE.labels)


@query(
    """SELECT c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 4 ELSE 0 END AS category, CASE WHEN c_custkey % 4 = 0 THEN 30 ELSE CAST(c_nationkey + 10 AS INTEGER) END AS symbol_size,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'd' END AS description, c_mktsegment AS node_type, CASE WHEN c_custkey % 2 = 0 THEN '#fff' END AS color FROM customer"""
)
def view_drawn_nodes(spark, d):
    k = F.col("c_custkey")
    size = F.when(k % 8 == 0, 0).when(k % 4 != 0, F.col("c_nationkey") + 10)
    found = load(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("node_type"), size.alias("size"), F.when(k % 3 != 0, "d").alias("description"), F.when(k % 2 == 0, "#fff").otherwise("").alias("color"))
    return view.drawn_nodes(found, {"AUTOMOBILE": 2, "BUILDING": 4})


@query("SELECT 'Customer#' || o_custkey AS source, o_orderstatus AS target, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'PLACED' END AS label, count(*) AS n FROM orders GROUP BY ALL")
def view_drawn_links(spark, d):
    k = F.col("o_orderkey")
    found = load(spark, d, "orders").select(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("from"), F.col("o_orderstatus").alias("to"), F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, "").alias("caption"), F.lit("PLACED").alias("type"))
    return view.drawn_links(found).groupBy("source", "target", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NODES_SQL}, m AS (SELECT name, arg_max(category, pos) AS category FROM nodes GROUP BY name) SELECT name FROM nodes JOIN m USING (name) WHERE contains(name, '07') AND m.category = 2 ORDER BY pos LIMIT 10")
def view_local_suggest(spark, d):
    return view.local_suggestions(nodes(spark, d), nodes(spark, d), "07", 2)


@query(f"WITH {NODES_SQL} SELECT name, category FROM nodes WHERE pos % 10 = 0")
def view_fallback(spark, d):
    return view.or_fallback(nodes(spark, d).filter("name = 'nobody'"), shown(spark, d)).select("name", "category")


@query(f"WITH {LINKS_SQL} SELECT caption, count(*) AS n FROM (SELECT * FROM links WHERE link_id % 2 = 0 OR link_id % 3 = 0) GROUP BY caption")
def view_merge_links(spark, d):
    every = links(spark, d)
    return view.merged_links(every.filter("link_id % 2 = 0"), every.filter("link_id % 3 = 0"), ["link_id"]).groupBy("caption").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, k, last_at, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, event_type, k) AS INTEGER) AS rank FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS k, max(ts) AS last_at FROM events GROUP BY ALL)) WHERE rank <= 10")
def view_history10(spark, d):
    events = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") % 20)
    return view.history(events, "user_id", "ts", ["event_type", "k"])


@query("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def view_prev_click(spark, d):
    return view.previous(load(spark, d, "events"), "user_id", "ts", "event_id", "event_type").select("event_id", "previous")


def requests(spark, d):
    c = F.col("c_custkey")
    name = F.when(c % 7 == 0, " ").otherwise(F.concat(F.lit("u"), (c % 1000).cast("string")))
    return load(spark, d, "customer").select(name.alias("username"), F.lit("pw").alias("password"), F.col("c_mktsegment").alias("role"), c.cast("string").alias("salt"))


def known_users(spark, d):
    known = load(spark, d, "customer").filter("c_custkey % 1000 < 50")
    name = F.concat(F.lit("u"), (F.col("c_custkey") % 1000).cast("string"))
    return known.select(name.alias("username"), us.hashed(F.lit("pw"), F.lit("s")).alias("password_hash"), F.lit("s").alias("salt"), F.lit("r").alias("role")).distinct()


@query(
    """WITH q AS (SELECT 'u' || (c_custkey % 1000) AS username, CAST(c_custkey AS VARCHAR) AS salt, c_mktsegment AS role FROM customer WHERE c_custkey % 7 <> 0)
SELECT username, sha256(salt || ':pw') AS password_hash, role FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY salt) AS rn FROM q WHERE username NOT IN (SELECT 'u' || (c_custkey % 1000) FROM customer WHERE c_custkey % 1000 < 50)) WHERE rn = 1"""
)
def user_register(spark, d):
    return us.register(known_users(spark, d), requests(spark, d)).select("username", "password_hash", "role")


@query(
    """WITH q AS (SELECT 'u' || (c_custkey % 1000) AS username, CAST(c_custkey AS VARCHAR) AS salt, c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0),
w AS (SELECT username, k FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY salt) AS rn FROM q WHERE username NOT IN (SELECT 'u' || (c_custkey % 1000) FROM customer WHERE c_custkey % 1000 < 50)) WHERE rn = 1)
SELECT username, CAST(i AS INTEGER) AS id, 'p' || (k % 5 + i) AS preference FROM w, (VALUES (1), (2), (3)) t(i) WHERE i <= k % 5"""
)
def user_preferences(spark, d):
    k = F.col("salt").cast("long")
    wanted = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= k % 5, F.concat(F.lit("p"), (k % 5 + i).cast("string")))), lambda p: p.isNotNull())
    _, own, _ = us.register_with_preferences(known_users(spark, d), requests(spark, d).withColumn("preferences", wanted))
    return own


@query(
    """WITH q AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'u' || (c_custkey % 1000) END AS username FROM customer)
SELECT success, CASE WHEN success THEN 'registered' ELSE 'username is taken' END AS message, count(*) AS n FROM (SELECT username <> ' ' AND username NOT IN (SELECT 'u' || (c_custkey % 1000) FROM customer WHERE c_custkey % 1000 < 50) AS success FROM q) GROUP BY ALL"""
)
def user_register_outcome(spark, d):
    wanted = F.array().cast("array<string>")
    _, _, outcome = us.register_with_preferences(known_users(spark, d), requests(spark, d).withColumn("preferences", wanted))
    return outcome.groupBy("success", "message").agg(F.count(F.lit(1)).alias("n"))


def preferences(spark, d):
    events = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), "id", F.col("event_type").alias("preference"))


PREFERENCES_SQL = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY id) AS rn FROM (SELECT 'u' || user_id AS username, event_type AS preference, min(event_id) AS id FROM events GROUP BY user_id, event_type)) WHERE rn <= 3)"


KNOWN_SQL = "known AS (SELECT DISTINCT 'u' || (c_custkey % 1000) AS username, sha256('s:pw') AS password_hash, 's' AS salt, 'r' AS role FROM customer WHERE c_custkey % 1000 < 50)"


@query(f"WITH {PREFERENCES_SQL}, {KNOWN_SQL} SELECT username, role, (SELECT coalesce(string_agg(preference, ',' ORDER BY id), '') FROM p WHERE p.username = known.username) AS preferences FROM known WHERE username = 'u8' AND password_hash = sha256(salt || ':' || 'pw')")
def user_login(spark, d):
    found = us.login(known_users(spark, d), us.first_preferences(preferences(spark, d)), "u8", "pw")
    return found.withColumn("preferences", F.concat_ws(",", "preferences"))


@query(f"WITH {PREFERENCES_SQL} SELECT username, CAST(500 + rn AS INTEGER) AS id, 'About ' || preference AS title, 'feed' AS source, '/feed/' || (500 + rn) AS url FROM p")
def user_feed(spark, d):
    return us.feed(us.first_preferences(preferences(spark, d)))
