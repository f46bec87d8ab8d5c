"""Every registered query against its SQL on the same files."""

import os

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry_point

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = entry_point.queries()
ORACLE = entry_point.oracle_sql()
KINDS = {"BIGINT": T.LongType, "INTEGER": T.IntegerType, "DOUBLE": T.DoubleType, "VARCHAR": T.StringType, "BOOLEAN": T.BooleanType}


def sort_key(row):
    return tuple((v is not None, v) for v in row)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    found = frame.collect()
    described = duck.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
    types = {row[0]: row[1] for row in described}
    assert sorted(frame.columns) == sorted(types)
    for field in frame.schema:
        assert types[field.name] in KINDS, (field.name, types[field.name])
        assert isinstance(field.dataType, KINDS[types[field.name]]), (field, types[field.name])
    columns = sorted(types)
    order = [list(types).index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in duck.execute(ORACLE[name]).fetchall()), key=sort_key)
    actual = sorted((tuple(row[c] for c in columns) for row in found), key=sort_key)
    assert len(actual) == len(expected)
    assert actual == expected
    assert actual, "the query gives no rows, so it checks nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)
