"""Every registered query against its SQL twin on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import sorted_rows
from yardline import oracle, registry
from yardline.sources import testdata

DEFAULT_DIR = "/root/testdata/sf0.01"
SF_DIR = os.environ.get("ORACLE_SF_DIR", DEFAULT_DIR)
TABLES = ("part", "orders", "lineitem", "events")
QUERIES, ORACLE = registry.queries(), oracle.statements()


def family(kind: str) -> str:
    """What a type name of either engine holds: whole numbers, fractions, texts, truths or moments."""
    name = kind.lower().split("(")[0]
    known = {
        "whole": {"int", "integer", "bigint", "hugeint", "smallint", "long"},
        "fraction": {"double", "float"},
        "text": {"string", "varchar"},
        "truth": {"boolean"},
        "day": {"date"},
        "moment": {"timestamp", "timestamp_ntz"},
    }
    return next((of for of, names in known.items() if name in names), name)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, duck):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    theirs = {column[0]: family(str(column[1])) for column in cursor.description}
    ours = {name: family(kind) for name, kind in frame.dtypes}
    # Sums of whole numbers and of decimals may be wider there; a text column of nulls has no type.
    assert {n: k for n, k in ours.items() if k != theirs[n] and {k, theirs[n]} != {"whole", "decimal"}} == {}
    expected = sorted_rows(cursor.fetchall(), columns)
    actual = sorted_rows(frame.collect(), frame.columns)
    assert len(actual) == len(expected) > 0
    assert actual == expected


def test_limits_bind(spark):
    for name, limit in (("critical_idle_top", 25), ("stale_gps_top", 50), ("bottom_branches", 5)):
        assert QUERIES[name](spark, DEFAULT_DIR).count() == limit


def test_every_order_is_a_lease(spark):
    inputs = testdata.load(spark, DEFAULT_DIR)
    assert inputs.leases.count() == spark.read.parquet(f"{DEFAULT_DIR}/orders.parquet").count()
    assert inputs.asset_statuses.count() == inputs.trailers.count()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
