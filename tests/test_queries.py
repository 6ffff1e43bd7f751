"""Registered queries on the smallest tables, held against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", entry.SMOKE_DIR)
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(entry.queries())
