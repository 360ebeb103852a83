"""Orders, limits, top-k and newest-per-group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.settings import DEFAULTS


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_date"), F.desc("id")]


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key.

    A row number with a literal bound makes Spark keep at most ``k`` rows per
    key and map task before the shuffle, so a hot key moves only those.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def rank_stories_normal(stories: DataFrame) -> DataFrame:
    return stories.orderBy(
        F.desc("article_count"), F.desc_nulls_last("last_article_at"), F.desc_nulls_last("created_at"), F.asc("id")
    )


def rank_stories_score(stories: DataFrame) -> DataFrame:
    return stories.orderBy(
        F.desc_nulls_last("score"), F.desc("article_count"), F.desc_nulls_last("last_article_at"), F.asc("id")
    )


def partition_top_minor(stories: DataFrame, max_top: int, order: list[Column] | None = None) -> DataFrame:
    """Label stories ``top`` or ``minor``.

    Up to three stories are all shown; more are never all shown.  The size of
    the head follows from the first few rows of the order, so no total count
    and no window over the whole list is needed.
    """
    order = order or [F.desc("article_count"), F.desc_nulls_last("last_article_at"), F.asc("id")]
    head = stories.orderBy(*order).limit(max(max_top, 3) + 1)
    everything = Window.partitionBy(F.lit(0))  # over the bounded head only
    seen = F.count("*").over(everything)
    size = F.when(seen <= 3, seen).otherwise(F.least(F.lit(max_top), seen - 1))
    top = (
        head.select("id", size.alias("_n"), F.row_number().over(everything.orderBy(*order)).alias("_rn"))
        .filter(F.col("_rn") <= F.col("_n"))
        .select("id", F.lit("top").alias("_section"))
    )
    return stories.join(top, "id", "left").withColumn("section", F.coalesce("_section", F.lit("minor"))).drop("_section")


def latest_articles(
    articles: DataFrame, reads: DataFrame, visitor, ungrouped: bool = False, story: int | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    """One page of articles, newest first; read marks are looked up for the page only."""
    from storyloom.operators.rollups import with_is_read

    if ungrouped:
        articles = articles.filter(F.col("event_id").isNull())
    if story is not None:
        articles = articles.filter(F.col("event_id") == story)
    page = articles.select(
        "id", "title", "publisher_name", "published_date", "url", "word_count",
        "importance_score", "grouping_confidence", "event_id", "fetched_at",
    )
    page = page.orderBy(*newest_first()).offset(offset).limit(limit)
    return with_is_read(page, reads, visitor).orderBy(*newest_first())


def recent_titles(articles: DataFrame, k: int = 5) -> DataFrame:
    """Titles of the newest ``k`` articles per story, missing titles dropped after the cut."""
    newest = first_per(
        articles.filter(F.col("event_id").isNotNull()).select("event_id", "title", "published_date", "id"),
        ["event_id"], newest_first(), k,
    )
    listed = newest.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("_t"))
    titles = F.filter(F.transform("_t", lambda e: e["title"]), lambda t: t.isNotNull() & (t != ""))
    return listed.select("event_id", titles.alias("recent_titles"))


def latest_summary(summaries: DataFrame) -> DataFrame:
    """Newest summary per story; the text is carried only for the winning row of each map task."""
    return first_per(summaries, ["event_id"], [F.desc_nulls_last("generated_at"), F.desc("id")]).drop("rn")


def newest_article_per_story(articles: DataFrame) -> DataFrame:
    rows = articles.filter(F.col("event_id").isNotNull()).select("event_id", "id", "published_date", "fetched_at")
    order = [F.desc_nulls_last("published_date"), F.desc_nulls_last("fetched_at"), F.desc("id")]
    return first_per(rows, ["event_id"], order).drop("rn")


def few_shot(feedback: DataFrame, k: int = 5) -> DataFrame:
    return feedback.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(k)


def chat_context(articles: DataFrame, k: int = DEFAULTS.chat_articles, sources: int = DEFAULTS.chat_sources) -> DataFrame:
    """Newest ``k`` articles of every story; the first few are its cited sources.

    The cut is made on keys alone; texts join back for the survivors.
    """
    keys = articles.filter(F.col("event_id").isNotNull()).select("event_id", "id", "published_date")
    picked = first_per(keys, ["event_id"], newest_first(), k, rank="position")
    return picked.withColumn("is_source", F.col("position") <= sources)


def chat_history(messages: DataFrame, story: int | None = None, visitor=None) -> DataFrame:
    """User and assistant messages, oldest first within each conversation."""
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    if story is not None:
        rows = rows.filter(F.col("event_id") == story)
    if visitor is not None:
        rows = rows.filter(F.col("visitor_id") == F.lit(visitor))
    return rows.select("event_id", "visitor_id", "created_at", "id", "role", "content").orderBy("event_id", "visitor_id", "created_at", "id")
