"""Feed entries and landed pages to stored articles, gate by gate.

Gates are columns of one lineage: every entry row ends with the name of the
first gate it failed, so the drop report is one ``groupBy`` over that column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.functions.html import extract_main_content as main_content
from storyloom.functions.html import html_to_text, sanitize_html
from storyloom.operators.rank import first_per
from storyloom.operators.rollups import ago, now_col
from storyloom.session import cut_lineage
from storyloom.settings import DEFAULTS

ERROR_CHARS = 1000


def feeds_due(feeds: DataFrame, now, exclude_paused: bool = False) -> DataFrame:
    """Never fetched, or fetched longer ago than the feed's own interval."""
    interval = F.make_interval(mins=F.coalesce("fetch_interval_minutes", F.lit(DEFAULTS.fetch_interval_minutes)))
    due = feeds.filter(F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") < now_col(now) - interval))
    return due.filter(~F.coalesce("is_paused", F.lit(False))) if exclude_paused else due


def pick_description(entries: DataFrame) -> Column:
    """Raw description: the first source that is not empty."""
    available = [c for c in ("summary_detail", "summary", "description", "content_value") if c in entries.columns]
    return F.coalesce(*[text.non_empty(F.col(c)) for c in available])


def entry_date(entries: DataFrame) -> Column:
    return dates.published_at(F.col("published"), F.col("updated"))


def has_link(link: Column) -> Column:
    return link.isNotNull() & (link != "")


def _recent_failures(failures: DataFrame, now, days: int) -> DataFrame:
    return failures.filter(F.col("last_attempted_at") > ago(now, days=days))


def skip_recent_failures(entries: DataFrame, failures: DataFrame, now, days: int = DEFAULTS.failure_retry_days) -> DataFrame:
    recent = _recent_failures(failures, now, days).select(F.col("url").alias("link"))
    return entries.join(recent, "link", "left_anti")


def cap_cutoffs(countable: DataFrame, cap: int) -> DataFrame:
    """Per feed, the position of its ``cap``-th countable entry; feeds below the cap have none."""
    kept = first_per(countable.select("feed_id", "pos"), ["feed_id"], [F.asc("pos")], cap)
    return kept.groupBy("feed_id").agg(F.max("pos").alias("cutoff"), F.count("*").alias("_n")).filter(F.col("_n") == cap).drop("_n")


def cap_per_feed(entries: DataFrame, cap: int = DEFAULTS.max_entries_per_feed) -> DataFrame:
    """The first ``cap`` entries of every feed, in feed order."""
    return first_per(entries, ["feed_id"], [F.asc("pos")], cap).drop("rn")


def skip_existing_urls(entries: DataFrame, articles: DataFrame) -> DataFrame:
    return entries.join(_stored(entries, articles), "link", "left_anti")


def _stored(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Links of the batch that are stored: the stored side is reduced to the batch first."""
    batch = entries.filter(has_link(F.col("link"))).select("link").distinct()
    return articles.select(F.col("url").alias("link")).join(batch, "link", "left_semi").distinct()


def require_title_date(entries: DataFrame) -> DataFrame:
    return entries.filter((F.coalesce("title", F.lit("")) != "") & entry_date(entries).isNotNull())


def drop_promo_titles(entries: DataFrame) -> DataFrame:
    """Also removes stored articles, as articles carry the same column."""
    return entries.filter(~text.is_promo(F.col("title")))


def dedup_batch_urls(entries: DataFrame) -> DataFrame:
    """One entry per link, the last one in the batch."""
    return first_per(entries, ["link"], [F.desc("pos")]).drop("rn")


def with_word_count(scrapes: DataFrame) -> DataFrame:
    return scrapes.withColumn("word_count", text.word_count(F.col("text")))


def scrape_error(hard_words: int = DEFAULTS.hard_error_words) -> Column:
    """Error text of a scraped document, null when it is usable."""
    short = F.when(
        F.coalesce(F.col("text"), F.lit("")).eqNullSafe("") | (F.col("word_count") < hard_words),
        F.format_string("extracted text too short (<%d words) or empty: %d words", F.lit(hard_words), F.col("word_count")),
    )
    both = F.concat_ws(" | ", text.non_empty(F.col("error")), short)
    return text.non_empty(both)


def unique_scrapes(scrapes: DataFrame) -> DataFrame:
    """One document for each address: of several, one without an error, then the longest text."""
    text_length = F.length(F.coalesce("text", F.lit("")))
    order = [F.coalesce("error", F.lit("")) != "", text_length.desc(), F.col("text").asc_nulls_last(), F.col("html").asc_nulls_last()]
    return first_per(scrapes, ["url"], order).drop("rn")


def scrape_error_gate(scrapes: DataFrame) -> DataFrame:
    return with_word_count(scrapes).withColumn("scrape_error", scrape_error())


def min_word_gate(rows: DataFrame, min_words: int = DEFAULTS.min_words) -> DataFrame:
    return rows.filter(F.coalesce("word_count", F.lit(0)) >= min_words)


def non_event_gate(articles: DataFrame) -> DataFrame:
    kind = text.classify_article(F.col("title"), F.col("rss_description"), F.col("scraped_text_content"))
    return articles.filter(~text.is_non_event_type(kind))


def record_scrape_failures(failures: DataFrame, bad: DataFrame, now) -> DataFrame:
    """Upsert by url: one more attempt, newest error, first attempt kept.

    ``bad`` has url and error; a url counts once per run.
    """
    at = now_col(now)
    fresh = bad.groupBy("url").agg(F.max(F.left("error", F.lit(ERROR_CHARS))).alias("error")).select(
        "url", "error", F.lit(1).cast("long").alias("attempt_count"), at.alias("first_attempted_at"), at.alias("last_attempted_at")
    )
    known = failures.select("url", "error", F.coalesce("attempt_count", F.lit(1)).cast("long").alias("attempt_count"), "first_attempted_at", "last_attempted_at")
    return known.unionByName(fresh).groupBy("url").agg(
        F.max_by("error", "last_attempted_at").alias("error"),
        F.sum("attempt_count").alias("attempt_count"),
        F.min("first_attempted_at").alias("first_attempted_at"),
        F.max("last_attempted_at").alias("last_attempted_at"),
    )


def name_feeds(feeds: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Feeds without a name take the title of their documents, where ``titles`` (feed_id, feed_title) has one."""
    if titles is None:
        return feeds
    named = feeds.join(titles.select(F.col("feed_id").alias("id"), "feed_title"), "id", "left")
    return named.withColumn("name", F.coalesce(text.non_empty(F.col("name")), F.col("feed_title"))).select(*feeds.columns)


def join_entries_to_scrapes(entries: DataFrame, scrapes: DataFrame, feeds: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Scraped documents with their entry; the feed's title and name win."""
    feeds = name_feeds(feeds, titles)
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"), F.col("url").alias("feed_url"))
    publisher = F.coalesce(text.non_empty(F.col("feed_name")), text.host_name(F.col("feed_url")))
    return (
        entries.join(scrapes.withColumnsRenamed({"url": "link", "title": "scraped_title"}), "link")
        .join(names, "feed_id", "left")
        .withColumns({"title": F.coalesce(text.non_empty(F.col("title")), F.col("scraped_title")), "publisher_name": publisher})
        .drop("scraped_title", "feed_name", "feed_url")
    )


@dataclass(frozen=True)
class Ingest:
    """Result of one run; ``log`` has one row per entry with the gate it failed."""

    articles: DataFrame
    log: DataFrame
    failures: DataFrame
    feeds: DataFrame

    @property
    def gate_counts(self) -> DataFrame:
        return self.log.groupBy("gate").agg(F.count("*").alias("n"))


def _link_key(entries: DataFrame) -> DataFrame:
    """Join key of an entry: its link, or a key of its own so that entries
    without a link do not all meet in one partition."""
    own = F.concat_ws(":", F.lit("none"), F.col("feed_id"), F.col("pos"))
    return entries.withColumn("link_key", F.when(has_link(F.col("link")), F.col("link")).otherwise(own))


def gate_entries(entries: DataFrame, articles: DataFrame, failures: DataFrame, now, cap: int = DEFAULTS.max_entries_per_feed) -> DataFrame:
    """Entries with ``gate``: the first gate failed before any page is fetched, else null.

    Failure marks, stored marks and batch duplicates all meet the entries on
    the link, so one partitioning by link serves three joins.  The cap is a
    position per feed: a feed with a third of all entries adds one small row.
    """
    failed = (
        _recent_failures(failures, now, DEFAULTS.failure_retry_days)
        .select(F.col("url").alias("link_key"), F.lit(True).alias("_failed")).dropDuplicates(["link_key"])
    )
    stored = _stored(entries, articles).select(F.col("link").alias("link_key"), F.lit(True).alias("_stored"))
    keyed = _link_key(entries).withColumn("published_date", entry_date(entries))
    rows = keyed.join(failed, "link_key", "left").join(stored, "link_key", "left")
    countable = _link_key(entries).filter(F.col("link_key") == F.col("link")).join(failed, "link_key", "left_anti")
    rows = rows.join(cap_cutoffs(countable, cap), "feed_id", "left")
    gate = (
        # Entries behind the last processed one are never looked at.
        F.when(F.col("pos") > F.col("cutoff"), "over_cap")
        .when(~F.coalesce(has_link(F.col("link")), F.lit(False)), "no_link")
        .when(F.col("_failed"), "recent_failure")
        .when(F.col("_stored"), "stored")
        .when(F.coalesce("title", F.lit("")) == "", "no_title")
        .when(F.col("published_date").isNull(), "no_date")
        .when(text.is_promo(F.col("title")), "promo")
    )
    gated = cut_lineage(rows.withColumn("gate", gate).drop("_failed", "_stored", "cutoff"))
    last = gated.filter(F.col("gate").isNull()).groupBy("link_key").agg(F.max("pos").alias("_last"))
    duplicate = F.when(F.col("gate").isNull() & (F.col("pos") < F.col("_last")), "duplicate")
    return gated.join(last, "link_key", "left").withColumn("gate", F.coalesce("gate", duplicate)).drop("_last")


def ingest_articles(
    feeds: DataFrame, entries: DataFrame, scrapes: DataFrame, articles: DataFrame, failures: DataFrame, now,
    cap: int = DEFAULTS.max_entries_per_feed, min_words: int = DEFAULTS.min_words, titles: DataFrame | None = None,
) -> Ingest:
    """The whole chain; ``articles`` of the result are the new rows only.  ``titles`` names unnamed feeds."""
    feeds = name_feeds(feeds, titles)
    gated = gate_entries(entries, articles, failures, now, cap)
    candidates = gated.withColumn("raw_description", pick_description(gated))
    documents = scrape_error_gate(unique_scrapes(scrapes)).select(
        F.col("url").alias("scraped_url"), "text", F.col("html").alias("_html"), "word_count", "scrape_error"
    )
    names = feeds.select(F.col("id").alias("feed_id"), F.coalesce(text.non_empty(F.col("name")), text.host_name(F.col("url"))).alias("publisher_name"))
    # Rows that already failed a gate do not pick up a page text.
    on_link = (candidates["link_key"] == documents["scraped_url"]) & candidates["gate"].isNull()
    joined = candidates.join(documents, on_link, "left").join(names, "feed_id", "left")
    scraped = F.col("scraped_url").isNotNull()
    # Only rows that still pass pay for the Python description cleaner.
    passed = scraped & F.col("scrape_error").isNull() & (F.col("word_count") >= min_words)
    described = joined.withColumn("rss_description", html_to_text(F.when(passed, F.col("raw_description"))))
    kind = text.classify_article(F.col("title"), F.col("rss_description"), F.col("text"))
    gate = F.coalesce(
        F.col("gate"),
        F.when(~scraped, "not_scraped")
        .when(F.col("scrape_error").isNotNull(), "scrape_error")
        .when(F.col("word_count") < min_words, "too_short")
        .when(text.is_non_event_type(kind), "non_event"),
        F.lit("stored_now"),
    )
    logged = described.withColumn("gate", gate)
    new = logged.filter(F.col("gate") == "stored_now").select(
        F.col("feed_id").alias("feed_source_id"), F.col("link").alias("url"), "title", "publisher_name", "published_date",
        "rss_description", F.col("text").alias("scraped_text_content"), sanitize_html(F.col("_html")).alias("full_html_content"),
        "word_count", now_col(now).alias("fetched_at"),
    )
    bad = logged.filter(F.col("gate") == "scrape_error").select(F.col("link").alias("url"), F.col("scrape_error").alias("error"))
    attempted = entries.select(F.col("feed_id").alias("id"), F.lit(True).alias("_tried")).distinct()
    touched = feeds.join(attempted, "id", "left").withColumn(
        "last_fetched_at", F.when(F.col("_tried"), now_col(now)).otherwise(F.col("last_fetched_at"))
    ).drop("_tried")
    return Ingest(new, logged.select("feed_id", "pos", "gate"), record_scrape_failures(failures, bad, now), touched)


def is_bad_article(min_words: int = DEFAULTS.min_words) -> Column:
    kind = text.classify_article(F.col("title"), F.col("rss_description"), F.col("scraped_text_content"))
    return (
        F.coalesce(F.startswith(F.col("scraped_text_content"), F.lit(text.SCRAPE_ERROR_PREFIX)), F.lit(False))
        | (F.coalesce("word_count", F.lit(0)) < min_words)
        | text.is_non_event_type(kind)
    )


def cleanup_bad(articles: DataFrame, min_words: int = DEFAULTS.min_words) -> DataFrame:
    """Keep what a fresh ingest would store."""
    return articles.filter(~is_bad_article(min_words))


def read_pages(pages: DataFrame) -> DataFrame:
    """Landed pages to scraped documents: title, main text, word count, error."""
    content = pages.withColumn("_c", main_content(F.col("html")))
    extracted = content.select(
        F.col("url"), F.col("_c.title").alias("title"), F.col("_c.text").alias("text"), "html", F.lit(None).cast("string").alias("error")
    )
    return scrape_error_gate(extracted)
