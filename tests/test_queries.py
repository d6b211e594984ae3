"""Every registered query at the smallest scale; with SQL, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, close, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert got
        return
    res = con.execute(oracle)
    want, names = rows_of([d[0] for d in res.description], res.fetchall())
    assert cols == names
    assert len(got) == len(want)
    assert all(all(close(p, q) for p, q in zip(a, b)) for a, b in zip(got, want))


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 14
