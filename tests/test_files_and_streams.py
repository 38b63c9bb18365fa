import itertools

from pyspark.sql import functions as F

from graphloom.operators import documents as ops
from graphloom.operators import users as us
from graphloom.plans import trade
from graphloom.sources import csv
from graphloom.schema import EDGE_COLUMNS, NODE_COLUMNS, RAW_DOCUMENT
from graphloom.streaming import pipelines

DATA = "/root/testdata/sf0.001"


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A:1", 'say "hi", ok', "A", ["d2", "d1"], "line\nbreak"), ("A:2", "", "A", [], "")], "node_id string, name string, label string, docs array<string>, description string")
    edges = spark.createDataFrame([("A:1", "A:2", "T", "d1", "ev", 0.9, "")], "src string, dst string, rel_type string, source_doc_id string, evidence string, confidence double, section string")
    csv.write_graph(nodes, edges, str(tmp_path), single=True)
    back = {r.node_id: r for r in csv.read(spark, f"{tmp_path}/nodes", NODE_COLUMNS).collect()}
    assert (back["A:1"].name, back["A:1"].source_doc_ids, back["A:1"].description) == ('say "hi", ok', "d1;d2", "line\nbreak")
    assert back["A:2"].name == ""
    assert csv.read(spark, f"{tmp_path}/relationships", EDGE_COLUMNS).first().confidence == "0.90"


def test_clean_documents(spark):
    row = ("7", None, " kw ", None, "src", " u ", "sum", {"a：": " b ", "c": " "}, [("", " x "), ("", "x"), ("h", "")], "own", ["i", "i", " "], "html", "h", None, None)
    clean = ops.clean_documents(spark.createDataFrame([row], RAW_DOCUMENT), F.lit(None).cast("timestamp")).first()
    assert (clean.title, clean.keyword, clean.basic_info) == ("kw", "kw", {"a": "b"})
    assert [tuple(s) for s in clean.sections] == [("正文", "x")] and clean.images == ["i"] and clean.full_text == "sum\n\n正文\nx"
    empty = ops.clean_documents(spark.createDataFrame([(None,) * 15], RAW_DOCUMENT)).first()
    assert empty.full_text == "" and empty.doc_id is None and empty.sections == []


def test_streams_give_what_tables_give(spark, tmp_path):
    events = trade.load(spark, DATA, "events")
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    pipelines.upsert_sink(stream.select("user_id", "event_type", "ts", "event_id"), f"{tmp_path}/out", ("user_id", "event_type"), "ts", f"{tmp_path}/c1").start().processAllAvailable()
    got = pipelines.upserted(spark, f"{tmp_path}/out", ("user_id", "event_type"), "ts")
    expected = ops.upsert(events.limit(0).select("user_id", "event_type", "ts", "event_id"), events.select("user_id", "event_type", "ts", "event_id"), ("user_id", "event_type"), "ts")
    assert sorted(map(tuple, got.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    counts = pipelines.tumbling_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    counts.processAllAvailable()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, pipelines.tumbling_counts(events, "ts", "event_type").collect()))
    for q in spark.streams.active:
        q.stop()


def test_history_of_a_stream(spark, tmp_path):
    events = trade.load(spark, DATA, "events").select("user_id", "event_type", "ts", "event_id")
    late = {0: 1, 1: 0, 2: 2}  # the batches come out of order
    for part in range(3):
        events.filter(f"event_id % 3 = {late[part]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, number):
        for user, rows in itertools.groupby(sorted(map(tuple, batch.collect())), key=lambda r: r[0]):
            seen[user] = list(rows)

    writer = pipelines.history(stream, "user_id", "ts", "event_type", 2).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    expected = pipelines.history(events, "user_id", "ts", "event_type", 2).withColumn("last_at", F.col("last_at").cast("timestamp"))
    assert sorted(r for rows in seen.values() for r in rows) == sorted(map(tuple, expected.collect()))


def test_login_needs_the_password(spark):
    users = spark.createDataFrame([("u", "s", "r")], "username string, salt string, role string").withColumn("password_hash", us.hashed(F.lit("pw"), F.col("salt")))
    prefs = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "username string, id int, preference string")
    assert us.login(users, prefs, "u", "pw").first().preferences == ["a", "b"]
    assert us.login(users, prefs, "u", "no").count() == 0
    assert us.login(users, prefs.limit(0), "u", "pw").first().preferences == []
