"""Roll-ups per story kept up to date by signed changes, so that a read does not scan the articles.

What is kept has one row for each (story, feed): the number of articles, and the sum and number of their
importance scores.  All of these can be taken back, so a batch of changed articles is worth its rows
after the change less its rows before it; a feed counts for a story while it has an article there.
Sums are exact decimals of the scores to twelve places, so nothing drifts over many batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.rollups import grouped

KEY = ["event_id", "feed_source_id"]
SUMS = ["n", "importance_sum", "importance_n"]


def _score() -> Column:
    return F.col("importance_score").cast("decimal(24,12)")


def kept_rollup(articles: DataFrame) -> DataFrame:
    """The roll-up of all articles: where upkeep begins, and what it must always equal."""
    return _summed(_signed(articles, 1))


def _signed(articles: DataFrame, sign: int) -> DataFrame:
    score = F.coalesce(_score(), F.lit(0).cast("decimal(24,12)"))
    return grouped(articles).select(
        *KEY, F.lit(sign).cast("long").alias("n"), (score * sign).cast("decimal(38,12)").alias("importance_sum"),
        F.when(F.col("importance_score").isNotNull(), sign).otherwise(0).cast("long").alias("importance_n"),
    )


def _summed(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("decimal(38,12)" if c == "importance_sum" else "long").alias(c) for c in SUMS]
    return rows.groupBy(*KEY).agg(*sums).where("n <> 0 or importance_n <> 0 or importance_sum <> 0")


def rollup_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes of the roll-up from the rows of the changed articles before and after a batch.

    A new article has no row before, a deleted one none after; an unchanged one that is given on both sides is worth nothing.
    """
    return _summed(_signed(before, -1).unionByName(_signed(after, 1)))


def maintained(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """The kept roll-up after ``changes``; its rows without an article go."""
    return _summed(kept.unionByName(changes))


def story_totals(kept: DataFrame) -> DataFrame:
    """``event_id``, ``article_count``, ``feed_count`` and ``importance_avg`` of each story, from the kept roll-up alone."""
    average = F.when(F.sum("importance_n") > 0, (F.sum("importance_sum") / F.sum("importance_n")).cast("double")).otherwise(F.lit(0.0))
    return kept.groupBy("event_id").agg(F.sum("n").alias("article_count"), F.count("feed_source_id").alias("feed_count"), average.alias("importance_avg"))
