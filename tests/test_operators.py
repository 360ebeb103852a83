"""Rules that need tables: order, chains, ids, skew, storage and streams."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.operators import corrections, grouping, ingest, lifecycle, merging, payloads, proposing, rank, reads, rollups, updates, verdicts
from storyloom.operators.ids import with_new_ids
from storyloom.session import shared_dir
from storyloom.sources import tables
from storyloom.operators.components import components
from storyloom.streaming import streams

NOW = "2024-01-31 00:00:00"
T0 = dt.datetime(2024, 1, 1)

pair_lists = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14)


def in_order(pairs):
    gone, accepted = set(), []
    for pos, (keep, drop) in enumerate(pairs):
        ok = keep != drop and keep not in gone and drop not in gone
        if ok:
            gone.add(drop)
        accepted.append(ok)
    return accepted


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pair_lists)
def test_pairs_are_taken_in_order(spark, pairs):
    frame = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(pairs)], "pos long, keep long, drop long")
    got = {r.pos: r.accepted for r in merging.accept_in_order(frame).collect()}
    assert [got[i] for i in range(len(pairs))] == in_order(pairs)


def test_star_of_pairs_settles_together(spark):
    frame = spark.range(3000).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("keep"), (F.col("id") + 1).alias("drop"))
    assert merging.accept_in_order(frame).filter("accepted").count() == 3000


def test_a_long_chain_settles_in_few_steps(spark, monkeypatch):
    cuts = []
    cut = merging.cut_lineage
    monkeypatch.setattr(merging, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    n = 300
    chain = spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("keep"), (F.col("id") + 1).alias("drop"))
    got = {r.pos: r.accepted for r in merging.accept_in_order(chain).collect()}
    assert [got[i] for i in range(n)] == in_order([(i, i + 1) for i in range(n)])
    assert len(cuts) <= 16


def test_chains_end_at_the_survivor(spark):
    frame = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(101, 100)], "drop long, keep long")
    got = {r["drop"]: r["keep"] for r in merging.resolve_chains(frame).collect()}
    assert got == {**{i + 1: 0 for i in range(20)}, 101: 100}


def test_proposed_pairs(spark):
    stories = spark.createDataFrame([(1, "active"), (2, "cooling"), (3, "active"), (4, "archived")], "id long, status string")
    pairs = spark.createDataFrame(
        [(1, "1", "2", "0.70"), (2, "2", "3", "0.9"), (3, "x", "3", "0.9"), (4, "1", "3", "0.69"), (5, "1", "4", "0.9"), (6, "3", "3", "0.9"), (7, "1", "3", "high"), (8, "1", "3", None), (9, "2", "2", "1")],
        "pos long, older_id string, newer_id string, confidence string",
    ).withColumn("reason", F.lit("r"))
    got = {r.pos: r.outcome for r in merging.accept_merge_pairs(pairs, stories).collect()}
    assert got == {1: "merged", 2: "skipped", 3: "skipped", 4: "skipped", 5: "skipped", 6: "ignored", 7: "skipped", 8: "skipped", 9: "skipped"}


def test_new_ids_are_dense_and_repeatable(spark):
    old = spark.createDataFrame([(41,)], "id long")
    names = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"))
    first = {r.name: r.id for r in with_new_ids(names, "name", old).collect()}
    again = {r.name: r.id for r in with_new_ids(names.repartition(7), "name", old).collect()}
    assert sorted(first.values()) == list(range(42, 5042)) and first == again
    assert with_new_ids(names.limit(1), "name", old.limit(0)).first().id == 1


def article_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, event_id long, publisher_name string, published_date timestamp, title string, importance_score double, grouping_confidence double, proposed_event_name string")


def test_regroup_golden(spark):
    articles = article_rows(spark, [(i, None, p, T0 + dt.timedelta(days=i), f"t{i}", 0.1, 0.0, None) for i, p in [(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, "b"), (7, "c")]])
    stories = spark.createDataFrame(
        [(1, " Old  Name", "archived", T0, None, dt.datetime(2024, 1, 10), None), (2, "cool one", "cooling", T0, None, None, None), (3, "gone", "archived", T0, None, dt.datetime(2023, 6, 1), None)],
        "id long, name string, status string, created_at timestamp, last_article_at timestamp, archived_at timestamp, expires_at timestamp",
    )
    decisions = spark.createDataFrame(
        [(1, 1, "new", None, "old name"), (2, 2, "new", None, "old name"), (3, 3, "new", None, "Pair"), (4, 4, "new", None, "Pair"), (5, 5, "new", None, "pair"), (6, 6, "new", None, "pair"),
         (7, 7, "existing", 3, None), (8, 99, "new", None, "lost"), (9, 1, "new", None, "lost"), (10, 7, "existing", 77, None), (11, 7, "new", None, " "), (12, 7, "what", None, None)],
        "pos long, article_id long, decision string, event_id long, event_name string",
    ).withColumns({"importance_score": F.lit(0.0), "confidence": F.lit(None).cast("double")})
    result = grouping.apply_regroup(articles, stories, decisions, NOW)
    counts = {r.outcome: r.n for r in rollups.outcome_counts(result.log).collect()}
    # "old name" revives; "Pair" has one publisher; "pair" founds; "lost" has an unknown first article.
    assert counts == {"revived": 1, "new_singletons": 1, "new_events": 1, "existing": 1, "errors": 5}
    placed = {r.id: (r.event_id, r.proposed_event_name, r.importance_score) for r in result.articles.collect()}
    assert placed[1] == (1, None, 0.5) and placed[2][0] == 1
    assert placed[3] == (None, "Pair", 0.5) and placed[5][0] == placed[6][0] == 4 and placed[7][0] == 3
    after = {r.id: r for r in result.stories.collect()}
    assert after[1].status == "active" and after[1].archived_at is None and after[1].last_article_at == T0 + dt.timedelta(days=2)
    assert after[3].status == "active" and after[2].status == "cooling" and after[4].name == "pair"
    again = grouping.apply_regroup(result.articles, result.stories, decisions, NOW)
    assert {r.id: r.event_id for r in again.articles.collect()} == {r.id: r.event_id for r in result.articles.collect()}


def test_removal_that_leaves_one_disbands(spark):
    articles = article_rows(spark, [(i, e, "a", T0, "t", 0.1, 0.0, "x") for i, e in [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3)]])
    stories = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    summaries = spark.createDataFrame([(1, 1), (2, 2)], "id long, event_id long")
    removals = spark.createDataFrame([(1, 1, 1), (2, 2, 3), (3, 2, 6), (4, 9, 1)], "pos long, event_id long, article_id long")
    applied, left = corrections.apply_removals(articles, stories, summaries, removals, NOW)
    assert {r.id: r.event_id for r in applied.articles.collect()} == {1: None, 2: None, 3: None, 4: 2, 5: 2, 6: 3}
    assert sorted(r.id for r in applied.stories.collect()) == [2, 3] and [r.event_id for r in left.collect()] == [2]
    assert {r.pos: r.outcome for r in applied.log.collect()} == {1: "removed", 2: "removed", 3: "not_in_story", 4: "not_in_story"}
    # No article points to a story that is gone.
    live = applied.stories.select(F.col("id").alias("event_id"))
    assert applied.articles.filter("event_id is not null").join(live, "event_id", "left_anti").isEmpty()


def test_moved_article_shows_in_its_new_story(spark):
    articles = article_rows(spark, [(1, None, "a", T0, "t", 0.1, 0.0, None), (2, 5, "a", T0, "t", 0.1, 0.0, None)])
    stories = spark.createDataFrame([(5, "a", "archived", None, T0, None)], "id long, name string, status string, last_article_at timestamp, archived_at timestamp, expires_at timestamp").withColumn("created_at", F.lit(T0))
    moves = spark.createDataFrame([(1, 1, None, 5, None, None), (2, 2, 9, 5, None, None), (3, 2, 5, None, "New", "n")], "pos long, article_id long, from_event_id long, to_event_id long, new_name string, note string")
    moved = corrections.apply_moves(articles, stories, moves, NOW)
    assert {r.id: r.event_id for r in moved.articles.collect()} == {1: 5, 2: 6}
    after = {r.id: r for r in moved.stories.collect()}
    assert after[5].status == "active" and after[5].last_article_at == T0 and after[6].last_article_at is None
    assert {r.pos: r.outcome for r in moved.log.collect()} == {1: "applied", 2: "wrong_source", 3: "applied"}


def test_hot_story_counts(spark):
    """Half of all articles in one story: roll-ups, top-k and summaries agree with plain counts."""
    rows = spark.range(20000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("long").alias("event_id"), (F.col("id") % 11).alias("feed_source_id"),
        F.when(F.col("id") % 3 == 0, F.lit("p")).alias("publisher_name"), F.concat(F.lit("http://x/"), F.col("id") % 9000).alias("url"),
        (F.lit(T0).cast("timestamp") + F.make_interval(mins=(F.col("id") % 997).cast("int"))).alias("published_date"),
        (F.lit(T0).cast("timestamp") + F.make_interval(mins=(F.col("id") % 997).cast("int"))).alias("fetched_at"), F.lit(0.5).alias("importance_score"),
        F.lit("body").alias("scraped_text_content"), F.lit("").alias("rss_description"), F.lit("t").alias("title"),
    )
    no_reads = spark.createDataFrame([], "visitor_id long, article_id long, read_at timestamp")
    no_visits = spark.createDataFrame([], "visitor_id long, event_id long, last_visited_at timestamp")
    rolled = {r.event_id: r for r in reads.story_rollup(rows, no_reads, no_visits, 1).collect()}
    assert rolled[7].article_count == 10000 + 400 and rolled[7].feed_count == 11 and rolled[7].importance_avg == pytest.approx(0.5)
    assert rank.recent_titles(rows).count() == len(rolled)
    blocks = payloads.summary_payload(rows)
    assert blocks.count() == rows.select("event_id", "url").distinct().count()
    hot = [r.published_date for r in blocks.filter("event_id = 7").select("published_date").collect()]
    assert hot == sorted(hot, reverse=True)
    plan = rank.chat_context(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == 2


def test_cap_counts_only_processed_entries(spark):
    entries = spark.createDataFrame(
        [(1, i, f"t{i}", None if i == 0 else f"http://x/{i}", "2024-01-05T00:00:00Z", None) for i in range(30)], "feed_id long, pos long, title string, link string, published string, updated string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("summary_detail", "summary", "description", "content_value")})
    failures = spark.createDataFrame([("http://x/1", dt.datetime(2024, 1, 30)), ("http://x/2", dt.datetime(2024, 1, 1))], "url string, last_attempted_at timestamp")
    stored = spark.createDataFrame([("http://x/3",)], "url string")
    gates = {r.pos: r.gate for r in ingest.gate_entries(entries, stored, failures, NOW).collect()}
    assert gates[0] == "no_link" and gates[1] == "recent_failure" and gates[2] is None and gates[3] == "stored"
    # Positions 2 to 16 are the fifteen processed ones.
    assert [p for p, g in gates.items() if g is None] and gates[16] is None and gates[17] == "over_cap" and gates[29] == "over_cap"


def test_failures_upsert(spark):
    known = spark.createDataFrame([("a", "old", 2, T0, T0), ("b", "old", None, T0, T0)], "url string, error string, attempt_count long, first_attempted_at timestamp, last_attempted_at timestamp")
    bad = spark.createDataFrame([("a", "new" * 500), ("c", "x"), ("c", "x")], "url string, error string")
    got = {r.url: r for r in ingest.record_scrape_failures(known, bad, NOW).collect()}
    assert got["a"].attempt_count == 3 and len(got["a"].error) == 1000 and got["a"].first_attempted_at == T0
    assert got["b"].attempt_count == 1 and got["c"].attempt_count == 1


def test_word_gates(spark):
    text = [" ".join(["w"] * n) for n in (49, 50, 349, 350)]
    scrapes = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(text)] + [("4", text[3], "HTTP 500"), ("5", None, None)], "url string, text string, error string")
    got = {r.url: (r.word_count, r.scrape_error is not None) for r in ingest.scrape_error_gate(scrapes).collect()}
    assert got == {"0": (49, True), "1": (50, False), "2": (349, False), "3": (350, False), "4": (350, True), "5": (0, True)}
    assert ingest.min_word_gate(ingest.with_word_count(scrapes)).count() == 2


def test_verdict_of_a_feed_without_valid_entries(spark):
    entries = spark.createDataFrame([(1, 1, "t", None, "2024-01-05", None), (1, 2, "t", "http://x", "junk", None)], "feed_id long, pos long, title string, link string, published string, updated string")
    entries = entries.withColumns({c: F.lit(None).cast("string") for c in ("summary_detail", "summary", "description", "content_value")})
    scrapes = spark.createDataFrame([], "url string, text string, html string, error string")
    row = verdicts.feed_verdict(entries, scrapes).first()
    assert (row.entries_seen, row.entries_with_link, row.entries_with_date, row.sampled, row.overall_pass) == (2, 1, 1, 0, False)


def brute_components(members):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in members:
        parent[find(("b", b))] = find(("i", i))
    groups = {}
    for i, _ in members:
        groups.setdefault(find(("i", i)), set()).add(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_connected_like_union_find(spark):
    rng = random.Random(5)
    members = [(i, rng.randrange(160)) for i in range(150) for _ in range(1 + i % 2)] + [(1000 + i, 9000 + i // 2 + (i % 2) * 0) for i in range(40)] + [(2000 + i, 5000 + i) for i in range(30)] + [(2000 + i, 5001 + i) for i in range(30)]
    # Bands are vertices too, above all ids, so that no band is the smallest of its component.
    frame = spark.createDataFrame([(i, 100_000 + b) for i, b in members], "a long, b long")
    got = {r.id: r.root for r in components(frame).collect()}
    assert {i: root for i, root in got.items() if i < 100_000} == brute_components(members)
    assert components(frame.where("false")).count() == 0


def test_alike_texts_share_a_name(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [(1, base), (2, base), (3, base + " extra"), (4, " ".join(f"other{i}" for i in range(300))), (5, base)]
    articles = spark.createDataFrame([(i, None, f"T{i}", T0 + dt.timedelta(days=i), t, 0.5) for i, t in texts], "id long, event_id long, title string, published_date timestamp, scraped_text_content string, importance_score double")
    got = {r.article_id: (r.decision, r.event_name) for r in proposing.propose_new_clusters(articles).collect()}
    assert got[1] == got[2] == got[5] == got[3] == ("new", "T1") and got[4] == ("uncategorized", None)


def test_nearest_story_like_numpy(spark, monkeypatch):
    monkeypatch.setattr(proposing, "CENTROIDS_PER_TASK", 7)
    monkeypatch.setattr(proposing, "VECTORS_PER_TASK", 11)
    rng = np.random.default_rng(3)
    vectors, centers = rng.normal(size=(40, 8)), rng.normal(size=(25, 8))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], "event_id long, centroid array<double>")
    got = {r.id: r.event_id for r in proposing.nearest_story(left, right).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == dict(enumerate((unit(vectors) @ unit(centers).T).argmax(axis=1).tolist()))


def test_duplicate_names_like_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(9)]
    names = [" ".join(rng.sample(vocabulary, rng.randrange(1, 6))) for _ in range(60)] + ["same name here"] * 5
    stories = spark.createDataFrame([(i, n, "active", T0) for i, n in enumerate(names)], "id long, name string, status string, created_at timestamp")
    articles = spark.createDataFrame([], "id long, event_id long")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = {(r.older_id, r.newer_id) for r in proposing.propose_duplicates(stories, articles, vectors).collect()}
    first = {}
    for i, n in enumerate(names):
        first.setdefault(frozenset(n.split()), i)
    want = {(first[frozenset(n.split())], i) for i, n in enumerate(names) if first[frozenset(n.split())] != i}
    sets = sorted(first.items(), key=lambda e: e[1])
    want |= {(i, j) for a, i in sets for b, j in sets if i < j and len(a & b) / len(a | b) >= 0.7}
    assert got == want


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_all_read_like_pairs(spark, block):
    articles = [(n, n % 3) for n in range(40)] + [(7, 1), (8, None), (None, 1), (50, 9)]
    asked = [(1, 1), (1, 1), (2, 1), (2, 2), (None, 0), (3, None), (4, 77)]
    seen = [(1, 1), (1, 7), (1, 8), (1, 8), (2, 2), (2, None), (None, 3), (5, 4)]
    frames = spark.createDataFrame(seen, "visitor_id long, article_id long"), spark.createDataFrame(articles, "id long, event_id long"), spark.createDataFrame(asked, "visitor_id long, event_id long")
    got = corrections.mark_all_read(*frames, NOW, block).select("visitor_id", "article_id", "event_id")
    want = [(v, a, e) for v, e in set(asked) for a, story in articles if story == e is not None and (None in (v, a) or (v, a) not in seen)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_all_read_moves_no_pairs(spark):
    articles, people = spark.range(300).selectExpr("id", "id % 2 AS event_id"), spark.range(200)
    reads, asked = people.selectExpr("id AS visitor_id", "id AS article_id"), people.selectExpr("id AS visitor_id", "id % 2 AS event_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corrections.mark_all_read(reads, articles, asked, NOW)
        assert rows.count() == 200 * 150 - 200
        after_pairs, _, before_pairs = rows._jdf.queryExecution().sparkPlan().toString().partition("explode(_articles")
        assert before_pairs and "Join" not in after_pairs
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_store_is_published_as_a_whole(spark):
    base = tables.run_dir(shared_dir(spark), "store")
    frame = lambda name: spark.createDataFrame([(1, name)], "id long, name string")
    first = tables.write_snapshots({"stories": frame("a"), "feed_sources": frame("f")}, base)
    # A job that dies after its first table has published nothing.
    frame("b").write.parquet(f"{base}/stories/version=half")
    loaded = tables.load_tables(spark, base, ["stories", "feed_sources", "articles"])
    assert (loaded["stories"].first().name, loaded["feed_sources"].first().name, loaded["articles"].count()) == ("a", "f", 0)
    second = tables.write_snapshots({"stories": frame("c")}, base, parent=first)
    assert second == first + 1 == tables.store_number(spark, base)
    with pytest.raises(RuntimeError, match="published"):
        tables.write_snapshots({"stories": frame("d")}, base, parent=first)
    assert tables.load_tables(spark, base, ["stories"])["stories"].first().name == "c"


def test_versions_without_a_record_are_no_empty_table(spark):
    base = tables.run_dir(shared_dir(spark), "store")
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(f"{base}/stories/version=v1")
    with pytest.raises(RuntimeError, match="no record"):
        tables.load_tables(spark, base, ["stories"])


def test_two_scrapes_of_one_address_are_one_document(spark):
    scrapes = spark.createDataFrame([("u", "long text here", None, None), ("u", "longer text but failed", None, "HTTP 503"), ("u", "short", None, ""), ("v", None, None, None)], "url string, text string, html string, error string")
    assert sorted((r.url, r.text) for r in ingest.unique_scrapes(scrapes).collect()) == [("u", "long text here"), ("v", None)]


RSS = """<?xml version="1.0"?><rss><channel><title> Daily News </title><item><title>One</title><link>http://a/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;d1&lt;/p&gt;</description></item>
<item><title>Two</title><link>http://a/2</link><dc:date>2024-01-01T11:00:00.1234567+0100</dc:date><content:encoded><![CDATA[<p>c2</p>]]></content:encoded></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><title>Atom Feed</title><entry><title type="html">Three</title><link rel="self" href="http://b/self"/><link rel="alternate" href="http://b/3"/><published>2024-01-02T00:00:00Z</published><summary type="html">s3</summary></entry>
<entry><title>Four</title><link href="http://b/4"/><updated>2024-01-03T00:00:00Z</updated><content type="html">c4</content></entry></feed>"""


def test_feeds_as_they_come(spark, tmp_path):
    from storyloom.sources import feeds

    for number, document in ((1, RSS), (2, ATOM)):
        (tmp_path / f"feed_id={number}").mkdir()
        (tmp_path / f"feed_id={number}" / "a.xml").write_text(document)
    rows = feeds.read_feed_entries(spark, str(tmp_path)).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.pos, r.title, r.link, r.summary_detail, r.content_value) for r in rows] == [
        (1, 0, "One", "http://a/1", "<p>d1</p>", None), (1, 1, "Two", "http://a/2", None, "<p>c2</p>"),
        (2, 0, "Three", "http://b/3", "s3", None), (2, 1, "Four", "http://b/4", None, "c4"),
    ]
    dated = feeds.read_feed_entries(spark, str(tmp_path)).select("title", ingest.entry_date(feeds.read_feed_entries(spark, str(tmp_path))).cast("string").alias("at"))
    assert {r.title: r["at"] for r in dated.collect()} == {"One": "2024-01-01 10:00:00", "Two": "2024-01-01 10:00:00.123456", "Three": "2024-01-02 00:00:00", "Four": "2024-01-03 00:00:00"}
    titles = feeds.read_feed_titles(spark, str(tmp_path))
    assert {r.feed_id: r.feed_title for r in titles.collect()} == {1: "Daily News", 2: "Atom Feed"}
    named = ingest.name_feeds(spark.createDataFrame([(1, "http://a", None), (2, "http://b", "Own"), (3, "http://c", "")], "id long, url string, name string"), titles)
    assert {r.id: r.name for r in named.collect()} == {1: "Daily News", 2: "Own", 3: None}


def test_no_batch_stops_a_purge(spark):
    old = dt.datetime(2023, 1, 1)
    stories = spark.createDataFrame([(i, "active" if i < 250 else "archived", old, old, dt.datetime(2030, 1, 1)) for i in range(500)], "id long, status string, created_at timestamp, archived_at timestamp, expires_at timestamp")
    articles = spark.createDataFrame([(i, 250 + i) for i in range(250)], "id long, event_id long")
    proposals = spark.createDataFrame([], "id long, created_at timestamp")
    tick = lifecycle.lifecycle_tick(stories, articles, proposals, NOW)
    assert {r.outcome: r.n for r in tick.counts.collect()} == {"purged_empty": 250, "purged": 250} and tick.stories.count() == 0
    few = lifecycle.lifecycle_tick(stories, articles, proposals, NOW, empty_limit=200, archived_limit=200)
    assert {r.outcome: r.n for r in few.counts.collect()} == {"purged_empty": 200, "purged": 200}


def test_centroids_are_as_long_as_the_vectors(spark):
    articles = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "id long, event_id long")
    vectors = spark.createDataFrame([(i, [float(i + k) for k in range(80)]) for i in (1, 2, 3)], "vec_id long, embedding array<float>")
    row = proposing.story_centroids(articles, vectors).first()
    assert np.allclose(row.centroid, [1.5 + k for k in range(80)])


def test_lookup_of_missing_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 6), (4, None)], "pos long, story long")
    table = spark.createDataFrame([(5, "five")], "id long, name string")
    got = {r.pos: (r.name, r.has_story) for r in updates.lookup(rows, "story", table, "id", name="name").collect()}
    assert got == {1: (None, False), 2: ("five", True), 3: (None, False), 4: (None, False)}


def test_answers_lose_nothing(spark):
    answers = spark.createDataFrame(
        [(1, '{"assignments":[{"article_id":1},"bad",{"article_id":"2.0"},null,3]}'), (2, "{'assignments':[]}"), (3, '{"assignments":"x"}'), (4, '{"other":1}'), (5, '{"assignments":[]}'), (6, None)],
        "id long, content string",
    )
    got = {(r.id, r.place): (r.error, r.article_id) for r in payloads.parse_assignments(answers).collect()}
    assert got == {(1, 0): (False, 1), (1, 1): (True, None), (1, 2): (False, 2), (1, 3): (True, None), (1, 4): (True, None), (2, None): (True, None), (3, None): (True, None), (6, None): (True, None)}
    diffs = spark.createDataFrame([(1, '{"cooling_events":["7",8,9.0,"x",{"a":1}],"merge_candidates":5,"new_events":[{"name":"n"},"m"]}'), (2, "nothing")], "id long, content string")
    rows = payloads.parse_recluster_diff(diffs).collect()
    assert sorted((r.id, r.kind, r.payload) for r in rows) == sorted([
        (1, "cool", '{"event_id":7}'), (1, "cool", '{"event_id":8}'), (1, "cool", '{"event_id":9}'), (1, "error", "x"), (1, "error", '{"a":1}'),
        (1, "error", "5"), (1, "new", '{"name":"n"}'), (1, "error", "m"), (2, "error", "nothing"),
    ])


def test_snapshots_keep_the_old_version_until_published(spark):
    base = tables.run_dir(shared_dir(spark), "store")
    one = spark.createDataFrame([(1, "a", T0)], "id long, name string, created_at timestamp")
    tables.write_snapshot(one, base, "stories", version="v1")
    loaded = tables.load_tables(spark, base, ["stories", "articles"])
    assert loaded["articles"].count() == 0 and loaded["stories"].first().expires_at == T0 + dt.timedelta(hours=48)
    tables.write_snapshot(loaded["stories"].withColumn("name", F.lit("b")), base, "stories", version="v2")
    assert loaded["stories"].first().name == "a"
    assert tables.load_tables(spark, base, ["stories"])["stories"].first().name == "b"


def stream_of(spark, frame, name):
    path = tables.run_dir(shared_dir(spark), name)
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path), path


def test_sessions_take_late_and_unordered_rows(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    first = spark.createDataFrame([(1, at(10)), (1, at(0)), (2, at(5)), (1, at(47))], "event_id long, assigned_at timestamp")
    stream, path = stream_of(spark, first, "late")
    spark.createDataFrame([(1, at(40)), (3, at(400))], first.schema).write.mode("append").parquet(path)
    got = {(r.event_id, r.activated_at, r.expires_at, r.assigned) for r in streams.run_into_files(streams.story_sessions(stream), "late-out").collect()}
    assert got == {(1, at(0), at(95), 4), (2, at(5), at(53), 1)}


def test_store_is_idempotent_per_batch(spark):
    path = tables.run_dir(shared_dir(spark), "reads") + "/out"
    write = streams.append_new(path, ["visitor_id", "article_id"])
    one = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "visitor_id long, article_id long")
    write(one, 0)
    write(one, 0)
    write(spark.createDataFrame([(1, 2), (2, 2)], one.schema), 1)
    write(spark.createDataFrame([(1, 2), (2, 2)], one.schema), 1)
    got = sorted((r.visitor_id, r.article_id) for r in spark.read.schema(one.schema).parquet(path).collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_bar_shows_all_of_three_and_never_all_of_more(spark):
    for total, shown in ((1, 1), (3, 3), (4, 3), (9, 6), (40, 6)):
        frame = spark.range(total).select("id", (F.col("id") % 5).alias("article_count"), F.lit(T0).alias("last_article_at"))
        assert rank.partition_top_minor(frame, 6).filter("section = 'top'").count() == shown
    assert rank.partition_top_minor(spark.range(5).select("id", F.lit(1).alias("article_count"), F.lit(T0).alias("last_article_at")), 0).filter("section = 'top'").count() == 0


def test_feedback_keeps_equal_rows(spark):
    from storyloom.operators.updates import append_feedback, feedback_rows

    log = spark.createDataFrame([(3, 1, None, None, "move", None, T0)], "id long, article_id long, original_event_id long, corrected_event_id long, kind string, note string, created_at timestamp")
    rows = feedback_rows(spark.createDataFrame([(1,), (1,), (2,)], "a long"), "move", F.lit(T0), article=F.col("a"))
    got = append_feedback(log, rows)
    assert got.count() == 4 and got.select("id").distinct().count() == 4
