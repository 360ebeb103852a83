"""Streams over the event log, run to the end of the available input."""

from pyspark.sql import functions as F

from storyloom.catalog import fixtures
from storyloom.catalog.ingesting import feed_date
from storyloom.catalog.registry import VISITOR, query
from storyloom.operators import rollups
from storyloom.streaming import status, streams

_N = "(SELECT count(*) FROM documents)"


def _event_stream(t):
    return t.spark.readStream.schema(fixtures._LAYOUT["events"]).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("at", F.col("ts").cast("timestamp"))


def _assignments(t):
    n = t.raw("documents").count()
    story = F.floor(F.sqrt(F.col("event_id") % n)).cast("long")
    return _event_stream(t).select(story.alias("event_id"), F.col("at").alias("assigned_at"))


_SESSIONS = f"""
assigned AS (SELECT CAST(floor(sqrt(event_id % {_N})) AS BIGINT) AS event_id, ts FROM events),
marked AS (SELECT event_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_id ORDER BY ts) + INTERVAL '48' HOUR THEN 0 ELSE 1 END AS opens FROM assigned),
numbered AS (SELECT event_id, ts, sum(opens) OVER (PARTITION BY event_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marked),
sessions AS (SELECT event_id, min(ts) AS activated_at, max(ts) + INTERVAL '48' HOUR AS expires_at, count(*) AS assigned FROM numbered GROUP BY event_id, n),
closed AS (SELECT * FROM sessions WHERE expires_at <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL '1' HOUR)"""


@query("stream_story_sessions", f"WITH {_SESSIONS} SELECT * FROM closed")
def _(t):
    return streams.run_into_files(streams.story_sessions(_assignments(t)), "sessions")


@query("stream_story_status", f"""WITH {_SESSIONS} SELECT event_id, 'active' AS status, activated_at AS changed_at FROM sessions
 UNION ALL SELECT event_id, 'archived', expires_at FROM closed""")
def _(t):
    said = streams.run_into_files(status.story_status(_assignments(t)), "status")
    return status.net_changes(said).withColumnRenamed("at", "changed_at")


@query("stream_feed_health", """
WITH hours AS (SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL '1' HOUR AS hour_end, event_id % 20 AS feed_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3)
SELECT * FROM hours WHERE hour_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_type = 'error') - INTERVAL '1' HOUR""")
def _(t):
    errors = _event_stream(t).filter(F.col("event_type") == "error").select(F.col("at").alias("failed_at"), (F.col("event_id") % 20).alias("feed_id"))
    return streams.run_into_files(streams.feed_health(errors), "health")


@query("stream_ingest", f"""
SELECT DISTINCT e.link FROM feed_entries e JOIN events v ON v.event_id % {_N} = e.pos
WHERE e.link <> '' AND e.title <> '' AND {feed_date('coalesce(e.published, e.updated)')} IS NOT NULL AND NOT regexp_matches(e.title, '(?i)%\\s*off') AND e.link NOT IN (SELECT url FROM articles)""")
def _(t):
    n = t.raw("documents").count()
    arrivals = _event_stream(t).select((F.col("event_id") % n).alias("pos"), F.col("at").alias("arrived_at"))
    entries = arrivals.join(t.feed_entries, "pos").select("feed_id", "pos", "link", "title", "published", "updated", "arrived_at")
    return streams.stream_ingest(entries, "arrived_at", t.articles).select("link")


@query("stream_unread", f"""
WITH reads AS (SELECT DISTINCT user_id AS visitor_id, event_id % {_N} AS article_id FROM events WHERE event_type = 'view')
SELECT a.event_id, count(*) AS article_count, count(r.article_id) AS read_count, count(*) - count(r.article_id) AS unread_count
FROM articles a LEFT JOIN reads r ON r.article_id = a.id AND r.visitor_id = {{VISITOR}} WHERE a.event_id IS NOT NULL GROUP BY a.event_id""")
def _(t):
    n = t.raw("documents").count()
    views = _event_stream(t).filter(F.col("event_type") == "view")
    reads = streams.stream_reads(views.select(F.col("user_id").alias("visitor_id"), (F.col("event_id") % n).alias("article_id"), F.col("at").alias("read_at")))
    return rollups.story_unread_counts(t.articles, reads, VISITOR)
