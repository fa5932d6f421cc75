"""Every registered query against its SQL on the small tables."""

import math
import os

import pytest

import __spark_entry__ as spark_entry

ORACLES, QUERIES = spark_entry.oracle_sql(), spark_entry.queries()

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("conversations", "documents", "labels", "embeddings", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')"
        )
    return connection


def comparable(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(comparable(row[i]) for i in order) for row in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = [column[0] for column in expected.description]
    assert sorted(found.columns) == sorted(columns)
    types = {column[0]: str(column[1]).upper() for column in expected.description}
    names = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert {c: names.get(t, t) for c, t in types.items()} == dict(found.dtypes)
    left = rows(found.columns, found.collect())
    right = rows(columns, expected.fetchall())
    assert len(left) == len(right)
    assert len(right) > 0
    different = [(a, b) for a, b in zip(left, right) if a != b]
    assert not different, f"{len(different)} of {len(left)} rows differ, first: {different[0]}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
