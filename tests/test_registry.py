"""Every registered query against its DuckDB oracle on the smallest tables, and the entry smoke check."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.schema.fields) > 0


def test_every_query_has_ids_and_names_match():
    qs = entry.queries()
    assert set(SQL) <= set(qs)
    assert len([n for n in qs if not n.startswith("op") and n != "pipeline"]) >= 120


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert compare(got, want) is None
