"""Every query with SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("FOLDWISE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, SF_DIR)
    expected = duck.execute(entry_points.oracle_sql()[name])
    described = {column[0]: str(column[1]) for column in expected.description}
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == described
    order = sorted(described)
    names = list(described)
    wanted = [tuple(row[names.index(c)] for c in order) for row in expected.fetchall()]
    found = [tuple(row[c] for c in order) for row in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_ranks_the_runs(spark):
    rows = entry_points.entry(spark).collect()
    assert sorted(r.run for r in rows) == ["a", "b", "blend"]
    assert [r.auc for r in rows] == sorted((r.auc for r in rows), reverse=True)
