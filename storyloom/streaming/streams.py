"""Streaming forms of ingest, expiry, reader state and feed health.

Event time drives expiry: the batch operators measure it from ``now``, the
streams from the assignment time behind a watermark.  All aggregates are
Spark's own; sinks are idempotent because a micro-batch may be delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import is_promo
from storyloom.operators.ingest import entry_date, has_link
from storyloom.operators.updates import not_stored
from storyloom.session import shared_dir
from storyloom.settings import DEFAULTS
from storyloom.sources.tables import read_if_there, run_dir


# --- shapes ------------------------------------------------------------------


def gated_entries(entries: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Streamed entries that pass the gates known before a page is fetched, once per link.

    State holds one row per link for the length of the delay; older repeats
    are caught by the anti-join of the sink.
    """
    titled = F.coalesce("title", F.lit("")) != ""
    dated = entries.withColumn("published_date", entry_date(entries))
    good = F.coalesce(has_link(F.col("link")), F.lit(False)) & titled & F.col("published_date").isNotNull() & ~is_promo(F.col("title"))
    return dated.filter(good).withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["link"])


def story_sessions(assignments: DataFrame, delay: str = "1 hour", hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    """Closed active periods of stories: each assignment keeps a story active for ``hours``.

    A session window with that gap ends exactly where the expiry would be.
    """
    period = F.session_window("assigned_at", f"{hours} hours")
    return (
        assignments.withWatermark("assigned_at", delay).groupBy("event_id", period).agg(F.count("*").alias("assigned"))
        .select("event_id", F.col("session_window.start").alias("activated_at"), F.col("session_window.end").alias("expires_at"), "assigned")
    )


def feed_health(errors: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Scrape errors per feed and hour, emitted when the hour is closed."""
    hour = F.window("failed_at", width)
    return (
        errors.withWatermark("failed_at", delay).groupBy(hour, "feed_id").agg(F.count("*").alias("failures"))
        .select(F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), "feed_id", "failures")
    )


# --- sinks -------------------------------------------------------------------


def stored_before(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """What earlier micro-batches stored; a repeated batch does not see its own files."""
    stored = read_if_there(spark, schema, path, basePath=path)
    return spark.createDataFrame([], schema) if stored is None else stored.filter(F.col("batch") < batch_id).drop("batch")


def append_new(path: str, keys: list[str], known: DataFrame | None = None):
    """``foreachBatch`` function: store rows whose key is new, under the batch's own folder.

    The key is looked up among earlier batches and in ``known``, a table of
    record with the same key columns.  A repeated batch overwrites its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Kept for the lookups below; without it each would run the stream's state again.
        arrived = batch.dropDuplicates(keys).persist()
        try:
            if arrived.isEmpty():
                return
            fresh = not_stored(arrived, stored_before(spark, path, batch_id, batch.schema), keys)
            if known is not None:
                fresh = not_stored(fresh, known, keys)
            fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            arrived.unpersist()

    return write


def run_into_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into parquet; returns what was written."""
    spark = stream.sparkSession
    base = run_dir(shared_dir(spark), name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_into_store(stream: DataFrame, name: str, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Run a stream through ``append_new``; returns the stored rows."""
    spark = stream.sparkSession
    base = run_dir(shared_dir(spark), name)
    query = (
        stream.writeStream.foreachBatch(append_new(f"{base}/out", keys, known))
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# --- jobs --------------------------------------------------------------------


def stream_ingest(entries: DataFrame, arrived: str, articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """New links of a feed stream that are not stored yet."""
    gated = gated_entries(entries, arrived, delay)
    return run_into_store(gated, "ingest", ["link"], articles.select(F.col("url").alias("link")))


def stream_reads(reads: DataFrame) -> DataFrame:
    """Reads of a stream, one per (visitor, article): the table unread counts are taken from."""
    return run_into_store(reads, "reads", ["visitor_id", "article_id"])


def stream_visits(visits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Visits per (visitor, story, day) of a stream; the newest one is the last visit."""
    day = F.window("at", "1 day")
    daily = visits.withWatermark("at", delay).groupBy(day, "visitor_id", "event_id").agg(F.max("at").alias("last_visited_at"))
    return daily.select("visitor_id", "event_id", "last_visited_at")
