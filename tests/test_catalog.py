"""Every registered query against its oracle on the smallest data."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point
from check import RAW, canonical

from storyloom.catalog import QUERIES as OWN

from .conftest import SF

#: The queries of this catalog; those of the training-data operators have tests of their own.
QUERIES = {name: run for name, run in entry_point.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in entry_point.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in RAW.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = canonical(QUERIES[name](spark, SF).toPandas())
    if name in ORACLES:
        want = canonical(duck.sql(ORACLES[name]).df())
        assert list(got.columns) == list(want.columns)
        assert got.equals(want)


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.count() > 0 and "score" in rows.columns


def test_only_python_recoveries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"sanitize_pages"}
