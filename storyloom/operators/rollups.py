"""Per-story, per-feed and whole-store aggregates.

All aggregates have partial forms, so a story that owns a third of the rows
costs its map tasks nothing extra and its reducer one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def now_col(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def ago(now, **parts: int) -> Column:
    """``now`` minus an interval given as days/hours/mins/secs."""
    return now_col(now) - F.make_interval(**{k: F.lit(v) for k, v in parts.items()})


def later(now, **parts: int) -> Column:
    return now_col(now) + F.make_interval(**{k: F.lit(v) for k, v in parts.items()})


def left_join_sliced(rows: DataFrame, per_key: DataFrame, key: str, spread: str, slices: int | None = None) -> DataFrame:
    """Left-join one row per ``key`` to rows that are aggregated by that key next.

    Spark does not split a skewed join partition when the following aggregate
    relies on its partitioning, so one key with a third of all rows would be
    one task.  Here the key is cut into slices by ``spread`` and the small side
    repeated per slice; the aggregate then combines before its own shuffle.
    There are as many slices as shuffle partitions unless given, so a hot key
    can fill them all.
    """
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    return sliced.join(per_key.withColumn("_slice", every), [key, "_slice"], "left").drop("_slice")


def grouped(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("event_id").isNotNull())


def story_article_counts(articles: DataFrame) -> DataFrame:
    return grouped(articles).groupBy("event_id").agg(F.count("*").alias("article_count"))


def story_feed_counts(articles: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct feeds per story; ``approximate`` trades exactness for one shuffle less."""
    count = F.approx_count_distinct("feed_source_id") if approximate else F.countDistinct("feed_source_id")
    rows = grouped(articles).filter(F.col("feed_source_id").isNotNull())
    return rows.groupBy("event_id").agg(count.alias("feed_count"))


def story_importance_avg(articles: DataFrame) -> DataFrame:
    return grouped(articles).groupBy("event_id").agg(F.coalesce(F.avg("importance_score"), F.lit(0.0)).alias("importance_avg"))


def _distinct_reads(reads: DataFrame, visitor=None) -> DataFrame:
    if visitor is not None:
        reads = reads.filter(F.col("visitor_id") == F.lit(visitor))
    return reads.dropDuplicates(["visitor_id", "article_id"])


def story_read_counts(articles: DataFrame, reads: DataFrame, visitor=None) -> DataFrame:
    """(visitor, story, read_count) for the pairs that have reads."""
    placed = grouped(articles).select(F.col("id").alias("article_id"), "event_id")
    return (
        _distinct_reads(reads, visitor)
        .select("visitor_id", "article_id")
        .join(placed, "article_id")
        .groupBy("visitor_id", "event_id")
        .agg(F.count("*").alias("read_count"))
    )


def story_unread_counts(articles: DataFrame, reads: DataFrame, visitor) -> DataFrame:
    """Total, read and unread of every story for one visitor.

    Reads are counted per story before they meet the story totals, so the
    article table is aggregated once and never joined row by row to totals.
    """
    read = story_read_counts(articles, reads, visitor).select("event_id", "read_count")
    joined = story_article_counts(articles).join(read, "event_id", "left")
    read_count = F.coalesce("read_count", F.lit(0))
    return joined.select(
        "event_id",
        "article_count",
        read_count.alias("read_count"),
        F.greatest(F.lit(0), F.col("article_count") - read_count).alias("unread_count"),
    )


def story_unread_all_visitors(articles: DataFrame, reads: DataFrame) -> DataFrame:
    """Unread per (visitor, story) that has reads; any other pair equals the story total."""
    read = story_read_counts(articles, reads)
    return read.join(story_article_counts(articles), "event_id").select(
        "visitor_id", "event_id", "read_count", (F.col("article_count") - F.col("read_count")).alias("unread_count")
    )


def story_new_since_visit(articles: DataFrame, visits: DataFrame, visitor) -> DataFrame:
    """Articles fetched after the visitor's last visit; all of them when never visited."""
    seen = last_visits(visits, visitor)
    fresh = F.col("last_visited_at").isNull() | (F.col("fetched_at") > F.col("last_visited_at"))
    rows = left_join_sliced(grouped(articles).select("id", "event_id", "fetched_at"), seen, "event_id", "id")
    return rows.groupBy("event_id").agg(F.count_if(fresh).alias("new_since_visit"))


def with_is_read(articles: DataFrame, reads: DataFrame, visitor) -> DataFrame:
    mine = reads.filter(F.col("visitor_id") == F.lit(visitor)).select(F.col("article_id").alias("id"))
    marks = mine.distinct().withColumn("_read", F.lit(True))
    return articles.join(marks, "id", "left").withColumn("is_read", F.coalesce("_read", F.lit(False))).drop("_read")


def last_visits(visits: DataFrame, visitor) -> DataFrame:
    """(event_id, last_visited_at) of one visitor."""
    mine = visits.filter(F.col("visitor_id") == F.lit(visitor)).select("event_id", "last_visited_at")
    return mine.groupBy("event_id").agg(F.max("last_visited_at").alias("last_visited_at"))


def inbox_counts(articles: DataFrame, reads: DataFrame, visitor) -> DataFrame:
    """Total, read and unread articles that belong to no story."""
    inbox = articles.filter(F.col("event_id").isNull()).select("id")
    return with_is_read(inbox, reads, visitor).agg(
        F.count("*").alias("total"),
        F.count_if("is_read").alias("read"),
        F.count_if(~F.col("is_read")).alias("unread"),
    )


def stats(articles: DataFrame, stories: DataFrame, proposals: DataFrame, feedback: DataFrame, now, recent_hours: int = 24) -> DataFrame:
    """One row of store-wide counts; every table is aggregated on its own."""
    status = F.col("status")
    parts = [
        articles.agg(F.count("*").alias("articles_total"), F.count_if(F.col("event_id").isNull()).alias("articles_ungrouped")),
        stories.agg(
            F.count_if(status == "active").alias("events_active"),
            F.count_if(status == "cooling").alias("events_cooling"),
            F.count_if(status == "archived").alias("events_archived"),
            F.count_if((status == "archived") & (F.col("archived_at") >= ago(now, hours=recent_hours))).alias("archived_recently"),
        ),
        proposals.agg(F.count_if(F.col("applied") == 0).alias("proposals_pending")),
        feedback.agg(F.count("*").alias("feedback_count")),
    ]
    columns = [c for part in parts for c in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def feed_list(feeds: DataFrame, articles: DataFrame, failures: DataFrame) -> DataFrame:
    """Feeds with article count, last error of the feed address itself, and a label."""
    counts = articles.filter(F.col("feed_source_id").isNotNull()).groupBy(F.col("feed_source_id").alias("id")).agg(F.count("*").alias("article_count"))
    errors = failures.groupBy("url").agg(
        F.max_by("error", "last_attempted_at").alias("last_error"), F.max("last_attempted_at").alias("last_error_at")
    )
    label = F.when(F.coalesce("is_paused", F.lit(False)), "paused").when(F.col("last_error_at").isNotNull(), "error").otherwise("ok")
    return (
        feeds.join(counts, "id", "left")
        .join(errors, "url", "left")
        .select(
            "id", "url", "name", "fetch_interval_minutes", "last_fetched_at",
            F.coalesce("is_paused", F.lit(False)).alias("is_paused"),
            F.coalesce("article_count", F.lit(0)).alias("article_count"),
            "last_error", "last_error_at", label.alias("label"),
        )
    )


def same_source_stories(articles: DataFrame, max_articles: int = 2) -> DataFrame:
    """Small stories told by one publisher."""
    publisher = F.coalesce("publisher_name", F.lit(""))
    return (
        grouped(articles).groupBy("event_id")
        .agg(F.count("*").alias("article_count"), F.min(publisher).alias("low"), F.max(publisher).alias("high"))
        .filter((F.col("article_count") <= max_articles) & (F.col("low") == F.col("high")))
        .select("event_id", "article_count")
    )


def distinct_source_check(rows: DataFrame, key: str, publisher: str = "publisher_name", required: bool = True) -> DataFrame:
    """Per cluster: are there two different publishers?  No publisher counts as one value.

    Two values differ exactly when the lowest and the highest do, or when some
    are missing and some are not; both need no distinct count.
    """
    named = F.col(publisher)
    checked = rows.groupBy(key).agg(
        F.min(named).alias("_low"), F.max(named).alias("_high"),
        F.count_if(named.isNull()).alias("_missing"), F.count(named).alias("_named"),
    )
    distinct = (F.col("_named") > 0) & ((F.col("_low") != F.col("_high")) | (F.col("_missing") > 0))
    return checked.select(key, (distinct if required else F.lit(True)).alias("distinct_sources"))


def publishers_per_story(articles: DataFrame) -> DataFrame:
    """Distinct (story, publisher) rows with counts; a story's list is its rows in name order."""
    return grouped(articles).groupBy("event_id", "publisher_name").agg(F.count("*").alias("article_count"))


def min_articles(rollup: DataFrame, n: int = 1) -> DataFrame:
    return rollup.filter(F.col("article_count") >= n)


def outcome_counts(log: DataFrame, column: str = "outcome") -> DataFrame:
    """Run report of any operator that labels its rows."""
    return log.groupBy(column).agg(F.count("*").alias("n"))
