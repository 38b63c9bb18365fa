"""Queries against their SQL on rows that the smallest tables don't hold."""

import duckdb
import pandas as pd

from graphloom import plans
from graphloom.sources import markup


def same(spark, folder, name, **tables):
    """The rows of the query, after they were compared with those of its SQL on the same tables."""
    con = duckdb.connect()
    for table, frame in tables.items():
        path = f"{folder}/{table}.parquet"
        con.register("given", frame)
        con.execute(f"copy given to '{path}' (format parquet)")
        con.execute(f"create view {table} as select * from '{path}'")
    frame = plans.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    result = con.execute(plans.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert rows == expected
    return rows


def test_texts_without_sections(spark, tmp_path):
    texts = ["a\n b", "", " \n\t\n", None, "x" * 300, " " * 300]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="string")})
    rows = {r[0]: r[1:] for r in same(spark, tmp_path, "doc_content_stats", documents=documents)}
    assert rows[1] == (False, None, 0, 0) and rows[3] == (None,) * 4


def test_references_without_semicolon(spark, tmp_path):
    titles = ["a&amp;b", "cut&amp", "cut &am", "twice &amp;amp; &amp;copy;", "&copy", "&notit; &", "x &middot; y&copy;", ""]
    pages = pd.DataFrame({"page_id": range(1, len(titles) + 1), "url": "http://h/", "html": [f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>p</p></body></html>" for t in titles]})
    rows = same(spark, tmp_path, "page_documents", pages=pages)
    assert ("cut&amp" in {r[-1] for r in rows}) and len(rows) == len(titles)
    assert markup.parts("<img src='/a?b=1&copy=2&amp;c=3'>", "http://h/")["images"] == ["http://h/a?b=1&copy=2&c=3"]
