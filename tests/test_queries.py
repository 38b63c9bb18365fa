"""Every query against its twin in SQL, on the smallest tables."""

import math

import duckdb
import pytest

from graphloom import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        expected = [dict(zip(names, r)) for r in result.fetchall()]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(r[c]) for c in columns) for r in expected), key=repr)
