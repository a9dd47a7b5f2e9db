"""Every query that SQL can express gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def _rows(df):
    return sorted(tuple("∅" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"run_id", "node", "n", "types"} == set(df.columns) and df.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
