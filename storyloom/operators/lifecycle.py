"""Expiry, archive, purge and revival: story tables in, story tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.rollups import ago, grouped, later, now_col
from storyloom.session import cut_lineage
from storyloom.settings import DEFAULTS


def reset_expiry(now, hours: int = DEFAULTS.ttl_hours) -> Column:
    """Always a full period from ``now``, whatever the article's date."""
    return later(now, hours=hours)


def is_expired(now) -> Column:
    return F.coalesce((F.col("status") == "active") & (F.col("expires_at") < now_col(now)), F.lit(False))


def reap_expired(stories: DataFrame, now) -> DataFrame:
    expired = is_expired(now)
    return stories.withColumns({
        "status": F.when(expired, F.lit("archived")).otherwise(F.col("status")),
        "archived_at": F.when(expired, now_col(now)).otherwise(F.col("archived_at")),
    })


def purge_empty(stories: DataFrame, articles: DataFrame, now, **limits) -> DataFrame:
    from storyloom.operators.reads import empty_stories

    return stories.join(empty_stories(stories, articles, now, **limits).select("id"), "id", "left_anti")


def ancient_stories(stories: DataFrame, now, days: int = DEFAULTS.purge_archived_after_days, limit: int | None = DEFAULTS.purge_archived_batch) -> DataFrame:
    old = stories.filter((F.col("status") == "archived") & (F.col("archived_at") < ago(now, days=days)))
    return old.orderBy("archived_at", "id").limit(limit) if limit else old


def detach(articles: DataFrame, gone: DataFrame) -> DataFrame:
    """Clear the story of articles whose story is deleted (declared SET NULL)."""
    from storyloom.operators.updates import left_by_story

    dead = gone.select(F.col("id").alias("event_id"), F.lit(True).alias("_gone")).distinct()
    cleared = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("event_id"))
    return left_by_story(articles, dead).withColumn("event_id", cleared).drop("_gone")


def purge_ancient(stories: DataFrame, now, days: int = DEFAULTS.purge_archived_after_days, limit: int | None = DEFAULTS.purge_archived_batch) -> DataFrame:
    return stories.join(ancient_stories(stories, now, days, limit).select("id"), "id", "left_anti")


def purge_proposals(proposals: DataFrame, now, days: int = DEFAULTS.purge_archived_after_days) -> DataFrame:
    return proposals.filter(~F.coalesce(F.col("created_at") < ago(now, days=days), F.lit(False)))


@dataclass(frozen=True)
class Tick:
    """Result of one lifecycle pass."""

    stories: DataFrame
    articles: DataFrame
    proposals: DataFrame
    counts: DataFrame


def lifecycle_tick(
    stories: DataFrame, articles: DataFrame, proposals: DataFrame, now, empty_limit: int | None = DEFAULTS.purge_empty_batch, archived_limit: int | None = DEFAULTS.purge_archived_batch
) -> Tick:
    """Expire, purge empty, purge ancient; every story gets one outcome.

    The deletions are found once and kept as one small (id, outcome) table.
    """
    from storyloom.operators.reads import empty_stories

    reaped = reap_expired(stories, now)
    empty = cut_lineage(empty_stories(reaped, articles, now, limit=empty_limit).select("id", F.lit("purged_empty").alias("outcome")))
    rest = reaped.join(empty, "id", "left_anti")
    ancient = ancient_stories(rest, now, limit=archived_limit).select("id", F.lit("purged").alias("outcome"))
    removed = empty.unionByName(ancient)
    expired = stories.filter(is_expired(now)).select("id", F.lit("reaped").alias("outcome"))
    counts = removed.unionByName(expired).groupBy("outcome").agg(F.count("*").alias("n"))
    return Tick(
        stories=rest.join(ancient, "id", "left_anti"),
        articles=detach(articles, removed),
        proposals=purge_proposals(proposals, now),
        counts=counts,
    )


def _activated(stories: DataFrame, which: Column, now) -> DataFrame:
    return stories.withColumns({
        "status": F.when(which, F.lit("active")).otherwise(F.col("status")),
        "archived_at": F.when(which, F.lit(None)).otherwise(F.col("archived_at")),
        "expires_at": F.when(which, reset_expiry(now)).otherwise(F.col("expires_at")),
    })


def revive(stories: DataFrame, ids: DataFrame, now) -> DataFrame:
    """Bring the named archived stories back."""
    asked = ids.select("id", F.lit(True).alias("_asked")).distinct()
    marked = stories.join(asked, "id", "left")
    which = F.coalesce(F.col("_asked") & (F.col("status") == "archived"), F.lit(False))
    return _activated(marked, which, now).drop("_asked")


def revive_recent(stories: DataFrame, now, days: int = DEFAULTS.revive_recent_days) -> DataFrame:
    recent = (F.col("status") == "archived") & (F.col("last_article_at") >= ago(now, days=days))
    return _activated(stories, F.coalesce(recent, F.lit(False)), now)


def backfill_expiry(stories: DataFrame, now) -> DataFrame:
    """Give stories without an expiry a full period."""
    return stories.withColumn("expires_at", F.coalesce("expires_at", reset_expiry(now)))


def reset_active_expiry(stories: DataFrame, now) -> DataFrame:
    """Give every active story a full period."""
    return stories.withColumn("expires_at", F.when(F.col("status") == "active", reset_expiry(now)).otherwise(F.col("expires_at")))


def mark_seen_in_recluster(stories: DataFrame, now) -> DataFrame:
    seen = F.when(F.col("status").isin("active", "cooling"), now_col(now))
    previous = F.col("last_seen_in_recluster_at") if "last_seen_in_recluster_at" in stories.columns else F.lit(None).cast("timestamp")
    return stories.withColumn("last_seen_in_recluster_at", F.coalesce(seen, previous))


def stories_with_articles(articles: DataFrame) -> DataFrame:
    return grouped(articles).select(F.col("event_id").alias("id")).distinct()
