"""Queries of the operators that SQL can express, against it."""

import duckdb
import pytest

from trailgraph.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in ("documents", "sales", "sale_lines", "clients"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    df, expected = QUERIES[name](spark, DATA), sql.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    found = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert found == sorted(repr([r[expected.columns.index(c)] for c in columns]) for r in expected.fetchall()) and found
