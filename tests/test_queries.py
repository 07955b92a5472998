"""Every registered query next to its DuckDB text, on the whole of the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    from checks.oracles import ORACLES

    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "trending_score" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, sf, name):
    ok, note = compare(spark, sf, name, QUERIES[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, sf, name):
    ok, note = compare(spark, sf, name, QUERIES[name], None)
    assert ok, note
