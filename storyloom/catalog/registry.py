"""Registered queries: each runs on the derived tables and may have an oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.catalog import fixtures
from storyloom.session import apply_session_conf, cut_lineage

NOW = "2024-01-31 00:00:00"
VISITOR = 7


class Tables:
    """Derived tables as attributes, raw ones through ``raw``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = apply_session_conf(spark)
        self.sf_dir = sf_dir
        fixtures.register_raw(self.spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.VIEWS:
            raise AttributeError(name)
        frame = fixtures.view(self.spark, name)
        setattr(self, name, frame)
        return frame

    def raw(self, name: str) -> DataFrame:
        return fixtures.raw(self.spark, self.sf_dir, name)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {name: F.round(F.col(name), digits) for name, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles) if doubles else df


def positioned(df: DataFrame) -> DataFrame:
    """``df`` with each row's place in its order, from 1.

    Rows are numbered within their sorted partition; only one count per partition is summed up.
    """
    marked = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    placed = marked.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("position", place).drop("_at", "_part", "_before", "exact_score")


def query(name: str, oracle: str | None = None, order: str | None = None):
    """Register a query; with ``order``, the oracle's ORDER BY, both sides also give each row's position.

    A column ``exact_score`` only orders rows and is not returned.
    """
    if order:
        columns = "* EXCLUDE (exact_score)" if "exact_score" in order else "*"
        oracle = f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS position FROM ({oracle}) AS unplaced"

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(
            lambda spark, sf_dir: rounded((positioned if order else lambda df: df)(build(Tables(spark, sf_dir)))),
            fixtures.with_views(oracle.replace("{NOW}", fixtures.NOW).replace("{VISITOR}", str(VISITOR))) if oracle else None,
        )
        return build

    return register
