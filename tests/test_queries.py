"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DIR)
    columns = sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
