"""Every registered query that SQL can state against that SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import bag
from workload.queries import queries as corpus_queries
from workload.views import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row.total == row.kept + row.no_date + row.no_keyword == 200


def test_every_query_has_sql():
    """All but those that SQL cannot state, which are tested with their operators."""
    assert set(corpus_queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want, got = bag(result.fetchall(), names), bag(df.collect(), df.columns)
    assert sum(want.values()) > 0 and got == want
