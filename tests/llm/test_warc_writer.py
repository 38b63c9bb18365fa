import bisect
import gzip
import hashlib
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import warc_writer
from graphloom.llm._common import shared_path

SCHEMA = "page_id long, url string, html string, payload string, kind int, digest string, refers_to long"


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            payload = (html or "").encode()
            first[payload] = min(first.get(payload, i), i)
    out, used = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        payload = (html or "").encode()
        response = first.get(payload, i) == i and (payload, i) not in used
        used.add((payload, i))
        out.append((i, len(payload), warc_writer.base32_sha1(payload), "response" if response else "revisit", None if response else first[payload]))
    return sorted(out, key=str)


def files_of(directory):
    path = directory.removeprefix("file://")
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.startswith("shard-") and n.endswith(".gz")}


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}\r\nWARC: y", "same é" if i % 3 == 0 else f"<p>{i}</p>\r\n\r\n") for i in range(1, 60)]
    rows += [(70, None, None), (71, "u", ""), (3, "again", "same é"), (3, "again", "same é"), (80, "u", "x" * 3_000_000), (81, "u", "y" * 10)]
    pages = spark.createDataFrame([(*r, "p", 1, "d", 2) for r in rows], SCHEMA)
    one, two = shared_path(spark, "t1"), shared_path(spark, "t2")
    manifest = warc_writer.write(pages, one, ranges=3, roll_bytes=2000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    back = warc_writer.read(spark, one).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in back if r.payload is not None}
    assert payloads[80] == b"x" * 3_000_000 and payloads[3] == "same é".encode() and payloads[70] == b""
    # the same records in another order, on other tasks: the same bytes
    warc_writer.write(pages.repartition(7).orderBy(F.rand()), two, ranges=3, roll_bytes=2000)
    assert files_of(one) == files_of(two)
    content = b"".join(gzip.decompress(x) for x in files_of(one).values())
    assert content.count(b"WARC/1.1\r\n") == len(rows)
    assert not [n for n in os.listdir(one.removeprefix("file://")) if n.endswith(".tmp")]
    for r in manifest.collect():
        assert hashlib.sha1(files_of(one)[r.file]).hexdigest() == r.sha1


def test_edges(spark):
    assert warc_writer.query(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None, None, None), (1, "u", None, "p", 1, "d", 2)]
    got = sorted((tuple(r) for r in warc_writer.query(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    digest = warc_writer.base32_sha1(b"")
    assert got == [(1, 0, digest, "response", None), (None, 0, digest, "revisit", 1)]
    directory = shared_path(spark, "t3")
    long = spark.createDataFrame([(1, "u", "aa", "", 1, "", 1), (2, "u", "aa", "", 1, "", 1), (3, "u", "aaaa", "", 1, "", 1), (4, "u", "aaaa", "", 1, "", 1)], SCHEMA)
    warc_writer.write(long, directory, min_revisit_bytes=3)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc_writer.read(spark, directory).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_the_same_table_gives_the_same_files_however_it_is_dealt(spark):
    pages = spark.range(120_000).selectExpr("id * id % 1000003 as page_id", "concat('u', id) as url", "concat('<p>', id % 5000, '</p>') as html")
    ways = [pages, pages, pages.repartition(13), pages.orderBy(F.rand())]
    found = []
    for k, way in enumerate(ways):
        directory = shared_path(spark, f"d{k}")
        warc_writer.write(way, directory, ranges=6, roll_bytes=2_000_000)
        found.append({n: hashlib.sha1(x).hexdigest() for n, x in files_of(directory).items()})
    assert len(found[0]) >= 6 and all(f == found[0] for f in found)


def test_bounds_are_counted(spark):
    rng = random.Random(4)
    dense = list(range(5000))
    cases = [dense, [7] * 100, [1], [], [*dense, 2**63 - 1, -(2**63)], [rng.randrange(-(2**63), 2**63) for _ in range(3000)], [10**15 + i for i in dense] + [rng.randrange(100) for _ in range(4000)]]
    for ids in cases:
        frame = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
        bounds = warc_writer.range_bounds(frame, 6, 64)
        assert bounds == sorted(set(bounds)) and set(bounds) <= set(ids)
        got = frame.select("id", warc_writer.below(bounds, F.col("id")).alias("part")).filter("id is not null").collect()
        assert all(r.part == bisect.bisect_right(bounds, r.id) for r in got)
        sizes = Counter(r.part for r in got)
        if len(set(ids)) > 2000:
            assert len(sizes) == 6 and max(sizes.values()) < 1.5 * min(sizes.values())


def test_urls_come_back_as_they_were(spark):
    urls = ["http://x/a%20b", "a%0Db", "a\rb", " edge ", "", "é ", None, "x: y"]
    directory = shared_path(spark, "t4")
    warc_writer.write(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string"), directory)
    assert [r.url for r in sorted(warc_writer.read(spark, directory).collect(), key=lambda r: r.page_id)] == urls
