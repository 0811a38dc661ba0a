import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


def names():
    return sorted(importlib.import_module("sparkstrata.plans.queries").QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if oracle := entry.oracle_sql().get(name):
        cursor = con.execute(oracle)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in sorted(columns)]
        assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in cursor.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
