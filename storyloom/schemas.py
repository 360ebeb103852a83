"""Explicit schemas of the tables of record."""

from pyspark.sql import types as T

_TS = T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FEED_SOURCES = _struct(
    id=T.LongType(), url=T.StringType(), name=T.StringType(),
    fetch_interval_minutes=T.IntegerType(), last_fetched_at=_TS, created_at=_TS,
    is_paused=T.BooleanType(),
)

ARTICLES = _struct(
    id=T.LongType(), feed_source_id=T.LongType(), url=T.StringType(), title=T.StringType(),
    publisher_name=T.StringType(), published_date=_TS, rss_description=T.StringType(),
    raw_rss_item=T.StringType(), scraped_text_content=T.StringType(),
    full_html_content=T.StringType(), word_count=T.IntegerType(), fetched_at=_TS,
    event_id=T.LongType(), importance_score=T.DoubleType(), grouping_confidence=T.DoubleType(),
    grouped_at=_TS, proposed_event_name=T.StringType(),
)

STORIES = _struct(
    id=T.LongType(), name=T.StringType(), description=T.StringType(), status=T.StringType(),
    created_at=_TS, last_article_at=_TS, archived_at=_TS, expires_at=_TS,
    summary_article_count=T.IntegerType(), last_summary_at=_TS, summary_version=T.IntegerType(),
    last_seen_in_recluster_at=_TS,
)

EVENT_SUMMARIES = _struct(
    id=T.LongType(), event_id=T.LongType(), summary_json=T.StringType(),
    article_ids=T.ArrayType(T.LongType()), generated_at=_TS, article_count=T.IntegerType(),
    model_used=T.StringType(),
)

GROUPING_FEEDBACK = _struct(
    id=T.LongType(), article_id=T.LongType(), original_event_id=T.LongType(),
    corrected_event_id=T.LongType(), kind=T.StringType(), note=T.StringType(), created_at=_TS,
)

RECLUSTER_PROPOSALS = _struct(
    id=T.LongType(), kind=T.StringType(), payload=T.StringType(), created_at=_TS,
    applied=T.IntegerType(), applied_at=_TS, rationale=T.StringType(),
)

ARTICLE_READS = _struct(article_id=T.LongType(), visitor_id=T.StringType(), read_at=_TS)
EVENT_VISITS = _struct(visitor_id=T.StringType(), event_id=T.LongType(), last_visited_at=_TS)

SCRAPE_FAILURES = _struct(
    url=T.StringType(), error=T.StringType(), attempt_count=T.LongType(),
    first_attempted_at=_TS, last_attempted_at=_TS,
)

CHAT_MESSAGES = _struct(
    id=T.LongType(), event_id=T.LongType(), visitor_id=T.StringType(), role=T.StringType(),
    content=T.StringType(), model_used=T.StringType(), created_at=_TS,
)

TABLES = {
    "feed_sources": FEED_SOURCES,
    "articles": ARTICLES,
    "stories": STORIES,
    "event_summaries": EVENT_SUMMARIES,
    "grouping_feedback": GROUPING_FEEDBACK,
    "recluster_proposals": RECLUSTER_PROPOSALS,
    "article_reads": ARTICLE_READS,
    "event_visits": EVENT_VISITS,
    "scrape_failures": SCRAPE_FAILURES,
    "event_chat_messages": CHAT_MESSAGES,
}

# --- layouts of model answers -------------------------------------------------

ASSIGNMENT = _struct(
    article_id=T.StringType(), decision=T.StringType(), event_id=T.StringType(),
    event_name=T.StringType(), importance_score=T.StringType(), confidence=T.StringType(),
    reasoning=T.StringType(),
)
ASSIGNMENTS = _struct(assignments=T.ArrayType(ASSIGNMENT))

MERGE_PAIR = _struct(
    older_id=T.StringType(), newer_id=T.StringType(), confidence=T.StringType(), reason=T.StringType(),
)

_IDS = T.ArrayType(T.LongType())
SUMMARY = _struct(
    key_developments=T.ArrayType(T.StringType()),
    timeline_narrative=T.ArrayType(_struct(date=T.StringType(), text=T.StringType())),
    cross_source_synthesis=_struct(
        by_source=T.ArrayType(_struct(source=T.StringType(), observation=T.StringType())),
        synthesis=T.StringType(),
    ),
    progressive_summary=T.StringType(),
    article_count=T.LongType(),
    feed_count=T.LongType(),
    date_range=T.StringType(),
    article_ids=_IDS,
)
