"""The recurring jobs end to end on a store derived from the test tables."""

from storyloom.catalog.registry import NOW, Tables
from storyloom.plans import jobs
from storyloom.session import shared_dir
from storyloom.sources import tables

from .conftest import SF


def test_jobs_leave_a_consistent_store(spark):
    t = Tables(spark, SF)
    base = tables.run_dir(shared_dir(spark), "store")
    for name in ("articles", "stories", "feed_sources", "scrape_failures", "event_summaries", "recluster_proposals"):
        tables.write_snapshot(getattr(t, name), base, name)
    load = lambda name: tables.load_tables(spark, base, [name])[name]
    before = load("articles").count()

    gates = {r.gate: r.n for r in jobs.run_ingest(spark, base, t.feed_entries, t.scrapes, NOW).collect()}
    assert sum(gates.values()) == t.feed_entries.count()
    assert load("articles").count() == before + gates.get("stored_now", 0)
    assert load("articles").select("id").distinct().count() == load("articles").count()
    again = {r.gate: r.n for r in jobs.run_ingest(spark, base, t.feed_entries, t.scrapes, NOW).collect()}
    assert again.get("stored_now", 0) == 0

    total = load("articles").count()
    counts = {r.outcome: r.n for r in jobs.run_grouping(spark, base, t.decisions, NOW, forced=True).collect()}
    assert counts["existing"] > 0 and load("articles").count() == total
    merged = {r.outcome: r.n for r in jobs.run_dedup(spark, base, t.merge_pairs, NOW).collect()}
    assert load("articles").count() == total and load("grouping_feedback").count() == merged.get("merged", 0)
    jobs.run_recluster(spark, base, t.recluster_responses, NOW, auto_apply=True)
    assert load("recluster_proposals").filter("applied = 0 and kind in ('cool', 'revive') and created_at = timestamp'2024-01-31'").isEmpty()
    jobs.run_lifecycle(spark, base, NOW)
    placed = load("articles").filter("event_id is not null").selectExpr("event_id as id").distinct()
    known = load("stories").select("id")
    # What points nowhere now pointed nowhere in the test tables already.
    assert placed.join(known, "id", "left_anti").join(t.stories.select("id"), "id", "left_semi").isEmpty()
