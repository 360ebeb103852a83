"""The recurring jobs, each a chain of operators over the tables of record.

A job reads the current versions of its tables, builds all its results lazily, writes the changed
tables as new versions, publishes them together, and returns its run report.  Where another job has
published one of its tables meanwhile, nothing of it is published, and it runs again on what is there now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import corrections, grouping, ingest, lifecycle, merging, payloads, rollups
from storyloom.operators.ids import with_new_ids
from storyloom.operators.updates import append_feedback
from storyloom.sources.tables import StoreConflict, load_tables, store_number, write_snapshots

#: How often a job runs again because others published first.
ATTEMPTS = 5

Tables = dict[str, DataFrame]


def unit_of_work(spark: SparkSession, base: str, names: list[str], work: Callable[[Tables], tuple[Tables, DataFrame]]) -> DataFrame:
    """Run ``work`` on the current versions of the tables and publish the ones it changes; returns its report."""
    for attempt in range(ATTEMPTS):
        parent = store_number(spark, base)
        changed, report = work(load_tables(spark, base, names))
        try:
            write_snapshots(changed, base, parent=parent, reads=names)
            return report
        except StoreConflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError("unreachable")


def run_ingest(spark: SparkSession, base: str, entries: DataFrame, scrapes: DataFrame, now) -> DataFrame:
    """Entries and scraped documents into articles; returns the count per gate."""

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        result = ingest.ingest_articles(t["feed_sources"], entries, scrapes, t["articles"], t["scrape_failures"], now)
        fresh = with_new_ids(result.articles, "url", t["articles"])
        articles = t["articles"].unionByName(fresh, allowMissingColumns=True)
        return {"articles": articles, "scrape_failures": result.failures, "feed_sources": result.feeds}, result.gate_counts

    return unit_of_work(spark, base, ["feed_sources", "articles", "scrape_failures"], work)


def run_grouping(spark: SparkSession, base: str, decisions: DataFrame, now, forced: bool = False) -> DataFrame:
    """Apply a table of decisions, live or forced; returns the count per outcome."""
    apply = grouping.apply_regroup if forced else grouping.apply_live

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        result = apply(t["articles"], t["stories"], decisions, now)
        return {"articles": result.articles, "stories": result.stories}, rollups.outcome_counts(result.log)

    return unit_of_work(spark, base, ["articles", "stories"], work)


def run_dedup(spark: SparkSession, base: str, pairs: DataFrame, now) -> DataFrame:
    """Merge accepted pairs; returns the count per outcome."""

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        merged, outcomes = merging.dedup_events(t["articles"], t["stories"], pairs, now)
        gone = merged.dropped.select(F.col("id").alias("event_id"))
        changed = {
            "articles": merged.articles, "stories": merged.stories, "event_summaries": t["event_summaries"].join(gone, "event_id", "left_anti"),
            "grouping_feedback": append_feedback(t["grouping_feedback"], merged.feedback),
        }
        return changed, rollups.outcome_counts(outcomes)

    return unit_of_work(spark, base, ["articles", "stories", "event_summaries", "grouping_feedback"], work)


def run_recluster(spark: SparkSession, base: str, answers: DataFrame, now, auto_apply: bool = False) -> DataFrame:
    """Store the proposals of model answers, and apply status changes when asked; returns the count per kind."""
    parsed = payloads.parse_recluster_diff(answers)

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        proposals = payloads.write_proposals(t["recluster_proposals"], parsed, now)
        stories = lifecycle.mark_seen_in_recluster(t["stories"], now)
        if auto_apply:
            fresh = proposals.join(t["recluster_proposals"].select("id"), "id", "left_anti")
            stories, applied = payloads.apply_proposals(stories, fresh, now)
            proposals = t["recluster_proposals"].unionByName(applied, allowMissingColumns=True)
        return {"stories": stories, "recluster_proposals": proposals}, rollups.outcome_counts(parsed, "kind")

    return unit_of_work(spark, base, ["stories", "recluster_proposals"], work)


def run_lifecycle(spark: SparkSession, base: str, now) -> DataFrame:
    """Expire and purge; returns the count per outcome."""

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        tick = lifecycle.lifecycle_tick(t["stories"], t["articles"], t["recluster_proposals"], now)
        kept = t["event_summaries"].join(tick.stories.select(F.col("id").alias("event_id")), "event_id", "left_semi")
        return {"stories": tick.stories, "articles": tick.articles, "recluster_proposals": tick.proposals, "event_summaries": kept}, tick.counts

    return unit_of_work(spark, base, ["stories", "articles", "recluster_proposals", "event_summaries"], work)


_EDITED = ["articles", "stories", "event_summaries", "grouping_feedback"]


def _edit(spark: SparkSession, base: str, apply: Callable[[Tables], tuple[corrections.Applied, DataFrame]]) -> DataFrame:
    """One batch of editors' requests: tables, corrections log and summaries together; returns the count per outcome."""

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        done, summaries = apply(t)
        if done.gone is not None:
            summaries = summaries.join(done.gone.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_anti")
        changed = {"articles": done.articles, "stories": done.stories, "event_summaries": summaries, "grouping_feedback": append_feedback(t["grouping_feedback"], done.feedback)}
        return changed, rollups.outcome_counts(done.log)

    return unit_of_work(spark, base, _EDITED, work)


def run_moves(spark: SparkSession, base: str, moves: DataFrame, now) -> DataFrame:
    """Articles moved or added to stories; returns the count per outcome."""
    return _edit(spark, base, lambda t: (corrections.apply_moves(t["articles"], t["stories"], moves, now), t["event_summaries"]))


def run_removals(spark: SparkSession, base: str, removals: DataFrame, now) -> DataFrame:
    """Articles taken off stories, with the stories that fall apart; returns the count per outcome."""
    return _edit(spark, base, lambda t: corrections.apply_removals(t["articles"], t["stories"], t["event_summaries"], removals, now))


def run_merges(spark: SparkSession, base: str, merges: DataFrame, now) -> DataFrame:
    """Stories merged by hand; returns the count per outcome."""
    return _edit(spark, base, lambda t: (corrections.apply_merges_manual(t["articles"], t["stories"], merges, now), t["event_summaries"]))


def run_splits(spark: SparkSession, base: str, splits: DataFrame, now) -> DataFrame:
    """Articles split off into new stories; returns the count per outcome."""
    return _edit(spark, base, lambda t: (corrections.apply_splits(t["articles"], t["stories"], splits, now), t["event_summaries"]))


def run_summaries(spark: SparkSession, base: str, answers: DataFrame, now, regenerated: bool = False, model: str | None = None) -> DataFrame:
    """Save parsed summary answers (event_id, summary_json); returns the number saved."""

    def work(t: Tables) -> tuple[Tables, DataFrame]:
        summaries, stories = payloads.save_summary(t["event_summaries"], t["stories"], t["articles"], answers, now, regenerated, model=model)
        return {"event_summaries": summaries, "stories": stories}, answers.agg(F.count("*").alias("saved"))

    return unit_of_work(spark, base, ["event_summaries", "stories", "articles"], work)
