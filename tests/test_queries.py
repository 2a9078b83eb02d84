"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from trailgraph.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple("" if r[i] is None else str(round(r[i], 6)) if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    expected = sql.sql(SQL[name])
    assert comparable(df.columns, df.collect()) == comparable(expected.columns, expected.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["node"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
