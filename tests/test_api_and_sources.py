import gzip
import json

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.plans import trade
from graphloom.schema import TRADE
from graphloom.sources import config, pages, raw

DATA = "/root/testdata/sf0.001"


def test_engine(spark):
    engine = api.Engine(trade.vertices(spark, DATA), trade.edges(spark, DATA), TRADE)
    assert engine.suggest("NATION", "1").count() == 20
    nodes, links = engine.neighborhood("NATION_3", "1")
    names = {r.id for r in nodes.collect()}
    assert "NATION_3" in names and all(r["size"] >= 20 for r in nodes.collect())
    assert {r["from"] for r in links.collect()} | {r["to"] for r in links.collect()} <= names
    fewer, _ = engine.expand("NATION_3", ", ".join(sorted(names)[:3]))
    assert fewer.count() < nodes.count()
    assert engine.neighborhood("nobody", "x")[0].count() == 0
    for bad in (lambda: engine.suggest(" "), lambda: engine.suggest("a", "9"), lambda: engine.neighborhood("a", 1, "-1")):
        with pytest.raises(ValueError):
            bad()
    assert api.names_of("a, ,b,") == ("a", "b")


def test_responses(spark):
    body = gzip.compress("病".encode("gb18030"))
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    good = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=GB18030\r\n\r\n" + chunked
    rows = [(bytearray(good),), (bytearray(b"HTTP/1.1 404 No\r\n\r\nx"),), (bytearray(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nbad"),), (None,)]
    got = [r.r for r in spark.createDataFrame(rows, "b binary").coalesce(1).select(raw.parse_response("b").alias("r")).collect()]
    assert [g.body for g in got] == ["病", None, None, None] and got[1].error == "status 404" and got[2].error
    assert raw.decode(b"\xff\xff\xff") and raw.decode("é".encode(), "no-such") == "é"


def test_cards_and_pages(spark):
    card = {"key": "K", "abstract": "", "desc": "d", "card": [{"key": "a", "name": "", "value": ["x", "<b>x</b>", "y"]}, {"key": "a", "value": ["z"]}], "image": "//i/1.png"}
    html = "<dl><dt>A：</dt><dd>1</dd><dt>A</dt><dd><i>2</i></dd><dt>B</dt></dl><img src='//a/b.png'><img data-src=\"http://c/d.png\"><img src='//a/b.png'>"
    frame = spark.createDataFrame([(json.dumps(card), html), ('{"errno": 2}', "")], "c string, h string")
    got = frame.select(raw.parse_card(F.col("c")).alias("d"), raw.infobox(F.col("h")).alias("i"), raw.images(F.col("h")).alias("m")).collect()
    assert (got[0].d.title, got[0].d.summary, got[0].d.basic_info, got[0].d.images) == ("K", "d", {"a": "z"}, ["https://i/1.png"])
    assert got[0].i == {"A": "2"} and got[0].m == ["https://a/b.png", "https://c/d.png"]
    assert got[1].d is None and got[1].i == {} and got[1].m == []
    assert raw.keywords(spark.createDataFrame([(" a ",), ("",), (None,)], "k string"), "k").collect()[0].keyword == "a"
    noise = spark.createDataFrame([("",), ("© x",), ("登录",), ("text",)], "t string").select(pages.is_noise(F.col("t"), ["登录"], ["备案"]).alias("n")).collect()
    assert [r.n for r in noise] == [True, True, True, False]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"b": "x"}, "n": "3", "k": "null", "blank": ""}))
    c = config.load(str(path), ("a.b",))
    assert config.value(c, "a.b") == "x" and config.number(c, "n", 1, int) == 3 and config.number(c, "blank", 2.5) == 2.5
    assert config.keyword(c, "k") is None
    with pytest.raises(ValueError):
        config.load(str(path), ("a.c",))
    assert config.layered({"n": "1", "z": 0}, str(path), "absent.json", env={"z": "ZED"}, environ={"ZED": "9"}) == {"n": "3", "z": "9", "a": {"b": "x"}, "k": "null"}
