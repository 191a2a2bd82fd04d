"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_local import normal
from threadspark.catalog import registry
from threadspark.catalog.inputs import BASE

FOLDER = "/root/testdata/sf0.001"
ORACLES = registry.all_oracles()
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = normal(QUERIES[name](spark, FOLDER).toPandas())
    want = normal(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0
