"""Joined reads: the story list, story pages, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.scores import story_score
from storyloom.operators import rank
from storyloom.operators.lifecycle import reap_expired, stories_with_articles
from storyloom.operators.rollups import ago, grouped, last_visits, left_join_sliced, now_col, with_is_read
from storyloom.settings import DEFAULTS


def story_rollup(articles: DataFrame, reads: DataFrame, visits: DataFrame, visitor) -> DataFrame:
    """All per-story aggregates of one visitor in one pass over the articles.

    Which side of a join is broadcast is left to adaptive execution; where it
    shuffles, the story key is cut into slices.
    """
    rows = grouped(articles).select("id", "event_id", "feed_source_id", "importance_score", "fetched_at")
    rows = left_join_sliced(with_is_read(rows, reads, visitor), last_visits(visits, visitor), "event_id", "id")
    fresh = F.col("last_visited_at").isNull() | (F.col("fetched_at") > F.col("last_visited_at"))
    # First per (story, feed): the distinct feed count becomes a plain count,
    # and a hot story is spread over its feeds before it meets one reducer.
    per_feed = rows.groupBy("event_id", "feed_source_id").agg(
        F.count("*").alias("n"), F.count_if("is_read").alias("n_read"), F.count_if(fresh).alias("n_new"),
        F.sum("importance_score").alias("imp_sum"), F.count("importance_score").alias("imp_n"),
    )
    totals = per_feed.groupBy("event_id").agg(
        F.sum("n").alias("article_count"), F.sum("n_read").alias("read_count"), F.sum("n_new").alias("new_since_visit"),
        F.count("feed_source_id").alias("feed_count"), F.sum("imp_sum").alias("imp_sum"), F.sum("imp_n").alias("imp_n"),
    )
    average = F.when(F.col("imp_n") > 0, F.col("imp_sum") / F.col("imp_n")).otherwise(F.lit(0.0))
    return totals.withColumn("importance_avg", average).drop("imp_sum", "imp_n")


def story_list(
    stories: DataFrame, articles: DataFrame, reads: DataFrame, visits: DataFrame, visitor, now,
    status: str | None = None, min_articles: int = 1, sort: str = "normal", **knobs,
) -> DataFrame:
    """Stories with counts, unread, new since the last visit and score, ranked.

    The status test runs before and after expiry, as a freshly expired story
    leaves ``active`` but is not yet shown under ``archived``.
    """
    if status:
        stories = stories.filter(F.col("status") == status)
    stories = reap_expired(stories, now)
    if status:
        stories = stories.filter(F.col("status") == status)
    rollup = story_rollup(articles, reads, visits, visitor).withColumnRenamed("event_id", "id")
    # At least one article is asked for by default, so no story is kept without a roll-up row.
    joined = stories.join(rollup, "id", "inner" if min_articles > 0 else "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    listed = joined.select(
        "id", "name", "status", "created_at", "last_article_at", "archived_at", "expires_at",
        zero("article_count"), zero("read_count"), zero("feed_count"), zero("new_since_visit"),
        F.coalesce("importance_avg", F.lit(0.0)).alias("importance_avg"),
    ).withColumn("unread_count", F.greatest(F.lit(0), F.col("article_count") - F.col("read_count")))
    if min_articles > 0:
        listed = listed.filter(F.col("article_count") >= min_articles)
    if sort == "score":
        score = story_score(F.col("article_count"), F.col("last_article_at"), F.col("importance_avg"), now_col(now), **knobs)
        return rank.rank_stories_score(listed.withColumn("score", score))
    return rank.rank_stories_normal(listed.withColumn("score", F.lit(None).cast("double")))


def story_details(
    stories: DataFrame, articles: DataFrame, reads: DataFrame, summaries: DataFrame, visitor, now, ids: DataFrame | None = None
) -> DataFrame:
    """Story page rows: one per article, newest first within its story.

    An article row carries its story and the id of the story's newest summary;
    a story without articles has one row with a null article.  The list stays
    rows: a story may hold more articles than fit one record.
    """
    stories = reap_expired(stories, now)
    if ids is not None:
        stories = stories.join(ids.select("id"), "id", "left_semi")
    newest = rank.latest_summary(summaries.select("event_id", "generated_at", "id"))
    optional = {"description": "string", "summary_version": "int"}
    more = [F.col(c) if c in stories.columns else F.lit(None).cast(kind).alias(c) for c, kind in optional.items()]
    head = stories.select(F.col("id").alias("event_id"), "name", "status", "last_article_at", *more).join(
        newest.select("event_id", F.col("id").alias("summary_id"), F.col("generated_at").alias("summary_at")), "event_id", "left"
    )
    items = with_is_read(
        grouped(articles).select("event_id", "id", "title", "url", "publisher_name", "importance_score", "published_date", "word_count"), reads, visitor
    ).withColumnRenamed("id", "article_id")
    # An inner join can split a hot story on the article side; the rest are stories with no articles.
    filled = head.join(items, "event_id")
    empty = head.join(grouped(articles).select("event_id").distinct(), "event_id", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True).orderBy(
        "event_id", F.desc_nulls_last("published_date"), F.desc_nulls_last("article_id")
    )


def story_summaries(stories: DataFrame, summaries: DataFrame) -> DataFrame:
    """The newest summary of every story with its text, once a story; the page's rows name it by id."""
    newest = rank.latest_summary(summaries.select("event_id", "generated_at", "id")).select("id")
    texts = summaries.join(newest, "id", "left_semi").select("event_id", F.col("id").alias("summary_id"), "generated_at", "article_count", "summary_json")
    return texts.join(stories.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def search_articles(articles: DataFrame, stories: DataFrame, reads: DataFrame, keyword: str, visitor, limit: int = 20) -> DataFrame:
    """Case-insensitive search in title and description; ``%`` and ``_`` are wildcards.

    The page is cut first; story names and read marks are looked up for its rows only.
    """
    pattern = F.lit(f"%{keyword}%")
    hits = (
        articles.filter(F.ilike(F.col("title"), pattern) | F.ilike(F.col("rss_description"), pattern))
        .select("id", "title", "publisher_name", "published_date", "url", "word_count", "importance_score", "grouping_confidence", "event_id")
        .orderBy(*rank.newest_first())
        .limit(limit)
    )
    names = stories.select(F.col("id").alias("event_id"), F.col("name").alias("event_name"))
    return with_is_read(hits.join(names, "event_id", "left"), reads, visitor).orderBy(*rank.newest_first())


def few_shot_examples(feedback: DataFrame, stories: DataFrame, k: int = 5) -> DataFrame:
    picked = rank.few_shot(feedback, k)
    original = stories.select(F.col("id").alias("original_event_id"), F.col("name").alias("original_event_name"))
    corrected = stories.select(F.col("id").alias("corrected_event_id"), F.col("name").alias("corrected_event_name"))
    return (
        picked.join(original, "original_event_id", "left").join(corrected, "corrected_event_id", "left")
        .select("id", "created_at", "article_id", "kind", "original_event_id", "corrected_event_id", "original_event_name", "corrected_event_name", "note")
    )


def few_shot_block(examples: DataFrame) -> DataFrame:
    """The few newest corrections as one text block; no row when there are none."""
    none = F.lit("(none)")
    line = F.concat(
        F.format_string("  - [%s] article_id=%s: from '", F.coalesce("kind", F.lit("move")), F.col("article_id").cast("string")),
        F.coalesce(F.nullif("original_event_name", F.lit("")), none), F.lit("' to '"),
        F.coalesce(F.nullif("corrected_event_name", F.lit("")), none), F.lit("'"),
        F.coalesce(F.concat(F.lit(" — "), F.nullif("note", F.lit(""))), F.lit("")),
    )
    # At most k rows reach this aggregate.
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("a"), (-F.col("id")).alias("b"), line.alias("line"))))
    lines = F.transform("_l", lambda e: e["line"])
    return (
        examples.agg(ordered.alias("_l")).filter(F.size("_l") > 0)
        .select(F.concat(F.lit("Recent editor corrections (treat as ground truth):\n"), F.array_join(lines, "\n")).alias("block"))
    )


def empty_stories(stories: DataFrame, articles: DataFrame, now, floor_seconds: int = DEFAULTS.purge_empty_floor_seconds, limit: int | None = DEFAULTS.purge_empty_batch) -> DataFrame:
    """Stories old enough to judge that no article points to, oldest first."""
    empty = stories.filter(F.col("created_at") < ago(now, secs=floor_seconds)).join(
        stories_with_articles(articles), "id", "left_anti"
    )
    return empty.orderBy("created_at", "id").limit(limit) if limit else empty


def summary_stale(stories: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stories whose newest article is younger than their newest summary."""
    newest = summaries.groupBy(F.col("event_id").alias("id")).agg(F.max("generated_at").alias("generated_at"))
    stale = F.col("last_article_at") > F.col("generated_at")
    return stories.select("id", "last_article_at").join(newest, "id", "left").select(
        "id", "last_article_at", "generated_at", F.coalesce(stale, F.lit(False)).alias("stale")
    )


def pending_suggestions(articles: DataFrame) -> DataFrame:
    """Proposed names waiting in the inbox."""
    return (
        articles.filter(F.col("event_id").isNull() & F.col("proposed_event_name").isNotNull())
        .groupBy("proposed_event_name").agg(F.count("*").alias("article_count"), F.max("published_date").alias("newest"))
    )


def story_display(articles: DataFrame) -> DataFrame:
    """Display size and certainty of every article."""
    from storyloom.functions.scores import importance_bucket, is_uncertain

    return articles.select(
        "id", importance_bucket(F.col("importance_score")).alias("bucket"), is_uncertain(F.col("grouping_confidence")).alias("uncertain")
    )
