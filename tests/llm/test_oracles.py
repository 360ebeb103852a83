"""Queries with a DuckDB form, on the smallest tables."""

import duckdb
import pytest

from storyloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = QUERIES[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]}) x").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
