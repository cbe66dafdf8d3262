"""Every named query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from mirthlake import catalogue_of_queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        r = duck.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
        assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["query_id", "mode", "id", "rank", "rrf", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
