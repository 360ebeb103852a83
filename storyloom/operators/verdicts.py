"""Feed quality: check the first dated, linked entries of every feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.functions.html import html_to_text, sanitize_html
from storyloom.operators.ingest import has_link, pick_description, unique_scrapes
from storyloom.operators.rank import first_per
from storyloom.operators.rollups import left_join_sliced
from storyloom.settings import DEFAULTS


def with_validity(entries: DataFrame) -> DataFrame:
    date = dates.verdict_date(*[F.col(c) for c in ("published", "updated", "created") if c in entries.columns])
    linked = F.coalesce(has_link(F.col("link")), F.lit(False))
    return entries.withColumns({"published_date": date, "has_link": linked, "has_date": date.isNotNull()}).withColumn(
        "valid", F.col("has_link") & F.col("has_date")
    )


def sample_entries(entries: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` valid entries of every feed."""
    return first_per(with_validity(entries).filter("valid"), ["feed_id"], [F.asc("pos")], k).drop("rn")


def entry_counts(entries: DataFrame, k: int = 5) -> DataFrame:
    """Seen entries per feed, and link/date counts up to the ``k``-th valid one.

    The stop position is a bounded top-k per feed, not a running total over
    the whole feed, so a huge feed is still counted by partial aggregates.
    """
    marked = with_validity(entries)
    first = first_per(marked.filter("valid").select("feed_id", "pos"), ["feed_id"], [F.asc("pos")], k)
    stops = first.groupBy("feed_id").agg(F.max("pos").alias("_stop"), F.count("*").alias("_n")).filter(F.col("_n") == k).drop("_n")
    looked_at = F.col("_stop").isNull() | (F.col("pos") <= F.col("_stop"))
    rows = left_join_sliced(marked.select("feed_id", "pos", "has_link", "has_date"), stops, "feed_id", "pos")
    return rows.groupBy("feed_id").agg(
        F.count("*").alias("entries_seen"),
        F.count_if(looked_at & F.col("has_link")).alias("entries_with_link"),
        F.count_if(looked_at & F.col("has_date")).alias("entries_with_date"),
    )


def _tags(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(tag) if isinstance(tag, str) else tag) for cond, tag in pairs]))


def passes_all_gates(min_words: int) -> Column:
    return (
        (F.coalesce("title", F.lit("")) != "") & F.col("has_link") & F.col("has_date") & F.col("scraper_error").isNull()
        & (F.col("scraped_words") >= min_words) & ~text.is_non_event_type(F.col("content_type"))
    )


def check_entries(sampled: DataFrame, scrapes: DataFrame, min_words: int = DEFAULTS.min_words) -> DataFrame:
    """Pass and fail tags of every sampled entry."""
    documents = unique_scrapes(scrapes).select(
        F.col("url").alias("link"), F.lit(True).alias("scraped"), F.coalesce("text", F.lit("")).alias("_text"),
        F.col("html").alias("_html"), text.non_empty(F.col("error")).alias("scraper_error"),
    )
    rows = sampled.withColumn("rss_description", html_to_text(pick_description(sampled))).join(documents, "link", "left")
    rows = rows.withColumns({
        "scraped": F.coalesce("scraped", F.lit(False)),
        "description_chars": F.coalesce(F.length("rss_description"), F.lit(0)),
        "description_words": text.word_count(F.col("rss_description")),
        "scraped_chars": F.coalesce(F.length("_text"), F.lit(0)),
        "scraped_words": text.word_count(F.col("_text")),
        "html_chars": F.length(sanitize_html(F.col("_html"))),
        "content_type": text.classify_article(F.col("title"), F.col("rss_description"), F.col("_text")),
    })
    titled = F.coalesce("title", F.lit("")) != ""
    enough = F.col("scraped_words") >= min_words
    clean = F.col("scraper_error").isNull()
    event = ~text.is_non_event_type(F.col("content_type"))
    scraped = F.col("scraped")
    passes = _tags(
        (F.col("description_chars") > 0, "rss_description_extracted"), (titled, "title_present"), (F.col("has_link"), "link_present"),
        (F.col("has_date"), "published_date_parsed"), (scraped & clean & enough, "full_text_extracted"),
        (scraped & (F.col("html_chars") > 0), "html_sanitized"), (event, F.concat(F.lit("event_type:"), "content_type")),
    )
    too_short = F.format_string("text_too_short:%dw<%dw", F.col("scraped_words"), F.lit(min_words))
    fails = _tags(
        (F.col("description_chars") == 0, "rss_description_missing"), (~titled, "title_missing"), (~F.col("has_link"), "link_missing"),
        (~F.col("has_date"), "published_date_unparsed"),
        (scraped & ~clean, F.concat(F.lit("scraper_error:"), F.left("scraper_error", F.lit(80)))),
        (scraped & clean & ~enough, too_short), (scraped & (F.col("html_chars") == 0), "html_missing_after_sanitize"),
        (~scraped, "no_scraped_doc"), (~event, F.concat(F.lit("non_event_type:"), "content_type")),
    )
    return rows.withColumns({"passes": passes, "fails": fails, "all_gates": passes_all_gates(min_words)}).drop("_text", "_html")


def feed_verdict(entries: DataFrame, scrapes: DataFrame, k: int = 5, min_words: int = DEFAULTS.min_words) -> DataFrame:
    """One verdict per feed."""
    checks = check_entries(sample_entries(entries, k), scrapes, min_words)
    usable = F.col("scraper_error").isNull()
    per_feed = checks.groupBy("feed_id").agg(
        F.count("*").alias("sampled"),
        F.count_if(F.col("scraped") & usable).alias("entries_scraped"),
        F.count_if(usable & (F.col("scraped_words") >= min_words)).alias("entries_full_text"),
        F.count_if("all_gates").alias("entries_all_gates"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    verdict = entry_counts(entries, k).join(per_feed, "feed_id", "left").select(
        "feed_id", "entries_seen", "entries_with_link", "entries_with_date",
        zero("sampled"), zero("entries_scraped"), zero("entries_full_text"), zero("entries_all_gates"),
    )
    share = lambda c: F.lit(100.0) * F.col(c) / F.greatest(F.lit(1), F.col("sampled"))
    needed = F.greatest(F.lit(1), F.floor(F.col("sampled") / 2))
    return verdict.withColumns({
        "pct_full_text": share("entries_full_text"),
        "pct_all_gates": share("entries_all_gates"),
        "overall_pass": (F.col("sampled") > 0) & (F.col("entries_seen") > 0) & (F.col("entries_all_gates") >= needed),
    })
