"""Every registered query against its SQL on another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def _sorted_rows(table):
    return sorted(repr([_plain(v) for v in row.values()]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    actual = entry_points.queries()[name](spark, sf_dir).toArrow()
    expected = duck.execute(SQL[name]).to_arrow_table()
    assert actual.column_names == expected.column_names
    assert [str(f.type) for f in actual.schema] == [str(f.type) for f in expected.schema]
    assert actual.num_rows == expected.num_rows > 0
    assert _sorted_rows(actual) == _sorted_rows(expected)


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
