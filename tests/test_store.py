"""Publishing: one of two racing writers wins, nothing is half published, jobs run again on conflict."""

import threading

import pytest

from storyloom.catalog.registry import NOW, Tables
from storyloom.plans import jobs
from storyloom.session import shared_dir
from storyloom.sources import tables

from .conftest import SF


@pytest.fixture
def base(spark):
    return tables.run_dir(shared_dir(spark), "store")


def frame(spark, name):
    return spark.createDataFrame([(1, name)], "id long, name string")


def names(spark, base):
    return {t: row.name for t, df in tables.load_tables(spark, base, ["stories", "feed_sources"]).items() if (row := df.first())}


def test_a_file_is_created_once(spark, base):
    assert tables.create_file(spark, f"{base}/a/1.json", "one")
    assert not tables.create_file(spark, f"{base}/a/1.json", "two")
    assert [r.value for r in spark.read.text(f"{base}/a").collect()] == ["one"]


def test_one_of_two_racing_writers_wins(spark, base):
    parent = tables.write_snapshots({"stories": frame(spark, "old"), "feed_sources": frame(spark, "f")}, base)
    meet, results = threading.Barrier(4), []

    def write(name):
        meet.wait()
        try:
            results.append((name, tables.write_snapshots({"stories": frame(spark, name)}, base, parent=parent)))
        except tables.StoreConflict:
            results.append((name, None))

    writers = [threading.Thread(target=write, args=(f"w{n}",)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    won = [name for name, number in results if number]
    assert len(results) == 4 and len(won) == 1 and tables.store_number(spark, base) == parent + 1
    assert names(spark, base)["stories"] == won[0]


def test_other_tables_are_no_conflict_and_numbers_are_not_lost(spark, base, monkeypatch):
    parent = tables.write_snapshots({"stories": frame(spark, "s"), "feed_sources": frame(spark, "f")}, base)
    create, taken = tables.create_file, []

    def beaten(session, path, text):
        if not taken:  # another job takes the number between the look and the record
            taken.append(tables.write_snapshots({"feed_sources": frame(spark, "g")}, base))
        return create(session, path, text)

    def race(session, path, text):
        monkeypatch.setattr(tables, "create_file", create)
        return beaten(session, path, text)

    monkeypatch.setattr(tables, "create_file", race)
    assert tables.write_snapshots({"stories": frame(spark, "t")}, base, parent=parent) == parent + 2
    assert taken == [parent + 1] and names(spark, base) == {"stories": "t", "feed_sources": "g"}
    with pytest.raises(tables.StoreConflict, match="feed_sources"):
        tables.write_snapshots({"stories": frame(spark, "u")}, base, parent=parent, reads=["feed_sources"])
    assert names(spark, base)["stories"] == "t"


def test_a_crash_between_data_and_record_publishes_nothing(spark, base, monkeypatch):
    parent = tables.write_snapshots({"stories": frame(spark, "old"), "feed_sources": frame(spark, "f")}, base)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "create_file", crash)
        with pytest.raises(OSError):
            tables.write_snapshots({"stories": frame(spark, "new"), "feed_sources": frame(spark, "n")}, base, version="v7", parent=parent)
    assert names(spark, base) == {"stories": "old", "feed_sources": "f"}
    assert tables.write_snapshots({"stories": frame(spark, "again")}, base, version="v7", parent=parent) == parent + 1
    assert names(spark, base) == {"stories": "again", "feed_sources": "f"}


def test_a_beaten_job_runs_again_on_what_is_there(spark, base):
    tables.write_snapshots({"stories": frame(spark, "old")}, base)
    seen = []

    def work(t):
        seen.append(t["stories"].first().name)
        if len(seen) == 1:
            tables.write_snapshots({"stories": frame(spark, "theirs")}, base)
        return {"stories": t["stories"].selectExpr("id", "concat(name, '+') as name")}, t["stories"].limit(0)

    jobs.unit_of_work(spark, base, ["stories"], work)
    assert seen == ["old", "theirs"] and names(spark, base)["stories"] == "theirs+"
    with pytest.raises(tables.StoreConflict):
        jobs.unit_of_work(spark, base, ["stories"], lambda t: (tables.write_snapshots({"stories": frame(spark, "x")}, base), ({"stories": t["stories"]}, None))[1])


def test_corrections_and_summaries_as_jobs(spark, base):
    t = Tables(spark, SF)
    tables.write_snapshots({n: getattr(t, n) for n in ("articles", "stories", "event_summaries", "grouping_feedback")}, base)
    load = lambda name: tables.load_tables(spark, base, [name])[name]
    total, logged = load("articles").count(), load("grouping_feedback").count()
    for run, requests in ((jobs.run_moves, t.moves), (jobs.run_removals, t.removals), (jobs.run_merges, t.manual_merges), (jobs.run_splits, t.splits)):
        counts = {r.outcome: r.n for r in run(spark, base, requests, NOW).collect()}
        assert counts and load("articles").count() == total
    assert load("grouping_feedback").count() > logged
    stories = load("stories").select("id")
    assert load("event_summaries").selectExpr("event_id as id").join(stories, "id", "left_anti").join(t.stories.select("id"), "id", "left_semi").isEmpty()
    answers = load("stories").orderBy("id").limit(2).selectExpr("id as event_id", "'{}' as summary_json")
    before = load("event_summaries").count()
    assert jobs.run_summaries(spark, base, answers, NOW).first().saved == 2 and load("event_summaries").count() == before + 2
