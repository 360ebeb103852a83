"""Merging stories: ordered acceptance of pairs, chains, and the table changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import normalize_event_name
from storyloom.operators.lifecycle import reset_expiry
from storyloom.operators.rank import first_per
from storyloom.operators.rollups import now_col, story_article_counts
from storyloom.operators.updates import change_rows, delete_rows, feedback_rows, left_by_story
from storyloom.session import cut_lineage
from storyloom.settings import DEFAULTS


def accept_in_order(pairs: DataFrame) -> DataFrame:
    """Pairs (pos, keep, drop) with ``accepted``, as if taken one by one in order.

    A pair is accepted when neither side was dropped by an accepted earlier
    pair.  Each round looks up, per story, the first two open pairs that would
    drop it.  A pair with no open earlier pair on its sides is accepted; one
    with a single such pair does the opposite of that pair, and runs of these
    are followed by doubling to where they begin, so a chain of any length
    settles in one round of as many steps as its length has bits.  What the
    accepted ones drop rejects later pairs; only open pairs go on.
    """
    typed = pairs.select("pos", "keep", "drop")
    settled = typed.filter("keep = drop").withColumn("accepted", F.lit(False))
    waiting = cut_lineage(typed.filter("keep <> drop"))
    while not waiting.isEmpty():
        first = waiting.groupBy("drop").agg(F.min("pos").alias("first"))
        second = waiting.join(first, "drop").filter("pos > first").groupBy("drop").agg(F.min("pos").alias("second"))
        marks = first.join(second, "drop", "left")
        on_keep = marks.select(F.col("drop").alias("keep"), F.col("first").alias("k1"), F.col("second").alias("k2"))
        on_drop = marks.select("drop", F.col("first").alias("d1"), F.col("second").alias("d2"))
        earlier = sum((F.coalesce((F.col(c) < F.col("pos")).cast("int"), F.lit(0)) for c in ("k1", "k2", "d1", "d2")), F.lit(0))
        cause = F.when(F.col("k1") < F.col("pos"), F.col("k1")).otherwise(F.col("d1"))
        ranked = cut_lineage(
            waiting.join(on_keep, "keep", "left").join(on_drop, "drop", "left").select("pos", "keep", "drop", earlier.alias("earlier"), cause.alias("cause"))
        )
        begins, opposed = _run_beginnings(ranked.filter("earlier = 1").select("pos", F.col("cause").alias("root"))), F.col("steps") % 2 == 1
        free = ranked.filter("earlier = 0").select("pos", F.lit(True).alias("accepted"))
        follow = begins.join(free.select(F.col("pos").alias("root")), "root").select("pos", (~opposed).alias("accepted"))
        decided = cut_lineage(ranked.join(free.unionByName(follow), "pos").select("pos", "keep", "drop", "accepted"))
        gone = decided.filter("accepted").select("drop", F.col("pos").alias("at"))
        left = ranked.join(decided.select("pos"), "pos", "left_anti").select("pos", "keep", "drop")
        checked = cut_lineage(
            left.join(gone.select(F.col("drop").alias("keep"), F.col("at").alias("keep_at")), "keep", "left")
            .join(gone.withColumnRenamed("at", "drop_at"), "drop", "left")
            .select("pos", "keep", "drop", F.coalesce(F.least("keep_at", "drop_at") < F.col("pos"), F.lit(False)).alias("dropped"))
        )
        settled = settled.unionByName(decided).unionByName(checked.filter("dropped").select("pos", "keep", "drop", F.lit(False).alias("accepted")))
        waiting = checked.filter("not dropped").drop("dropped")
    return settled


def _run_beginnings(causes: DataFrame) -> DataFrame:
    """(pos, root, steps): each pair that hangs on one other, followed to the pair its run begins with."""
    runs = cut_lineage(causes.withColumn("steps", F.lit(1).cast("long")))
    while True:
        step = runs.select(F.col("pos").alias("root"), F.col("root").alias("further"), F.col("steps").alias("more"))
        jumped = cut_lineage(
            runs.join(step, "root", "left").select(
                "pos", F.coalesce("further", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")
            )
        )
        runs = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return runs


def resolve_chains(accepted: DataFrame) -> DataFrame:
    """(drop, keep) with ``keep`` followed to the story that survives.

    Each round doubles the distance covered, so depth ``d`` takes ``log d`` rounds.
    """
    links = cut_lineage(accepted.select("drop", "keep"))
    while True:
        step = links.select(F.col("drop").alias("keep"), F.col("keep").alias("next"))
        jumped = cut_lineage(
            links.join(step, "keep", "left").select("drop", F.coalesce("next", "keep").alias("keep"), F.col("next").isNotNull().alias("moved"))
        )
        links = jumped.select("drop", "keep")
        if jumped.filter("moved").isEmpty():
            return links


def accept_merge_pairs(pairs: DataFrame, stories: DataFrame, min_confidence: float = DEFAULTS.dedup_confidence) -> DataFrame:
    """Outcome of every proposed pair: ``merged``, ``skipped`` or ``ignored`` (a self-pair)."""
    alive = stories.filter(F.col("status").isin("active", "cooling")).select("id")
    typed = pairs.select(
        "pos", F.col("older_id").try_cast("long").alias("keep"), F.col("newer_id").try_cast("long").alias("drop"),
        F.coalesce(F.col("confidence").try_cast("double"), F.when(F.col("confidence").isNull(), F.lit(0.0))).alias("confidence"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
    fit = (
        typed.filter(F.col("confidence") >= min_confidence)
        .join(alive.select(F.col("id").alias("keep")), "keep", "left_semi")
        .join(alive.select(F.col("id").alias("drop")), "drop", "left_semi")
    )
    decided = accept_in_order(fit)
    taken = decided.filter("accepted").select(F.col("pos").alias("_taken_at"), F.col("drop"))
    selfs = decided.filter(F.col("keep") == F.col("drop")).join(taken, "drop", "left")
    ignored = selfs.filter(F.col("_taken_at").isNull() | (F.col("_taken_at") > F.col("pos"))).select("pos", F.lit("ignored").alias("outcome"))
    merged = decided.filter("accepted").select("pos", F.lit("merged").alias("outcome"))
    return typed.join(merged.unionByName(ignored), "pos", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))


@dataclass(frozen=True)
class Merged:
    articles: DataFrame
    stories: DataFrame
    feedback: DataFrame
    dropped: DataFrame


def repoint(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles of dropped stories move to the surviving one."""
    target = links.select(F.col("drop").alias("event_id"), F.col("keep").alias("_to"))
    return left_by_story(articles, target).withColumn("event_id", F.coalesce("_to", "event_id")).drop("_to")


def merge_stories(articles: DataFrame, stories: DataFrame, accepted: DataFrame, now, kind: str = "dedup_merge", refresh: bool = True, note: Column | None = None) -> Merged:
    """Apply accepted (keep, drop) pairs to the tables.

    With ``refresh`` the surviving story takes the newest moved date, becomes
    active and gets a full period; a manual merge leaves it as it is.
    """
    links = resolve_chains(accepted)
    moved = articles.filter(F.col("event_id").isNotNull()).select("event_id", "published_date").join(links.withColumnRenamed("drop", "event_id"), "event_id")
    kept = stories
    if refresh:
        newest = moved.groupBy(F.col("keep").alias("id")).agg(F.max("published_date").alias("_newest"))
        roots = links.select(F.col("keep").alias("id")).distinct().join(newest, "id", "left")
        changes = stories.select("id", "last_article_at").join(roots, "id").select(
            "id", F.greatest("last_article_at", "_newest").alias("last_article_at"), F.lit("active").alias("status"),
            F.lit(None).cast("timestamp").alias("archived_at"), reset_expiry(now).alias("expires_at"),
        )
        kept = change_rows(stories, changes)
    names = stories.select("id", "name")
    logged = (
        accepted.join(names.select(F.col("id").alias("keep"), F.col("name").alias("keep_name")), "keep", "left")
        .join(names.select(F.col("id").alias("drop"), F.col("name").alias("drop_name")), "drop", "left")
    )
    default_note = F.concat(F.lit("merged '"), F.col("drop_name"), F.lit("' into '"), F.col("keep_name"), F.lit("'"))
    text = default_note if note is None else F.coalesce(F.nullif(note, F.lit("")), default_note)
    feedback = feedback_rows(logged, kind, now_col(now), original=F.col("drop"), corrected=F.col("keep"), note=text)
    return Merged(repoint(articles, links), delete_rows(kept, links, "id", "drop"), feedback, links.select(F.col("drop").alias("id")))


def dedup_events(articles: DataFrame, stories: DataFrame, pairs: DataFrame, now, min_confidence: float = DEFAULTS.dedup_confidence) -> tuple[Merged, DataFrame]:
    """Accept proposed pairs and merge; also returns the outcome of every pair."""
    outcomes = accept_merge_pairs(pairs, stories, min_confidence)
    outcomes = cut_lineage(outcomes)
    accepted = outcomes.filter(F.col("outcome") == "merged")
    note = F.concat(F.lit("llm: "), F.col("reason"))
    return merge_stories(articles, stories, accepted.select("pos", "keep", "drop", "reason"), now, note=note), outcomes


def primary_per_name(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Per normalised name the story with most articles, then the oldest."""
    counted = _named(stories, articles)
    return first_per(counted, ["norm"], [F.desc("n"), F.asc("created_at"), F.asc("id")]).select("norm", F.col("id").alias("primary_id"))


def _named(stories: DataFrame, articles: DataFrame) -> DataFrame:
    counts = story_article_counts(articles).select(F.col("event_id").alias("id"), F.col("article_count").alias("_n"))
    return (
        stories.select("id", "created_at", normalize_event_name(F.col("name")).alias("norm")).filter(F.col("norm") != "")
        .join(counts, "id", "left").select("id", "created_at", "norm", F.coalesce("_n", F.lit(0)).alias("n"))
    )


def dedup_by_name(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Planned actions: every other story of a name group merges into the primary, or goes when empty."""
    counted = _named(stories, articles)
    primary = first_per(counted, ["norm"], [F.desc("n"), F.asc("created_at"), F.asc("id")]).select("norm", F.col("id").alias("primary_id"))
    others = counted.join(primary, "norm").filter(F.col("id") != F.col("primary_id"))
    action = F.when(F.col("n") == 0, "delete_empty_phantom").otherwise("merge")
    return others.select(action.alias("action"), "primary_id", F.col("id").alias("secondary_id"), F.col("n").alias("article_count"))


def apply_dedup_by_name(articles: DataFrame, stories: DataFrame, now) -> Merged:
    actions = cut_lineage(dedup_by_name(stories, articles))
    pairs = actions.filter(F.col("action") == "merge").select(F.col("secondary_id").alias("pos"), F.col("primary_id").alias("keep"), F.col("secondary_id").alias("drop"))
    merged = merge_stories(articles, stories, pairs, now, kind="cli_dedup")
    phantoms = actions.filter(F.col("action") == "delete_empty_phantom").select(F.col("secondary_id").alias("id"))
    return Merged(merged.articles, delete_rows(merged.stories, phantoms), merged.feedback, merged.dropped.unionByName(phantoms))
