"""Editor actions as batches over request tables.

A request has a unique position; requests are judged against the tables as
they stand at the start of the batch, and each gets an outcome in ``log``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import host_name, non_empty, strip
from storyloom.operators.ids import with_new_ids
from storyloom.operators.lifecycle import reset_expiry
from storyloom.operators.merging import accept_in_order, merge_stories
from storyloom.operators.rollups import grouped, left_join_sliced, now_col, same_source_stories, story_article_counts
from storyloom.operators.updates import change_rows, delete_rows, feedback_rows, left_by_story, lookup, not_stored
from storyloom.session import cut_lineage
from storyloom.settings import DEFAULTS


@dataclass(frozen=True)
class Applied:
    articles: DataFrame
    stories: DataFrame
    feedback: DataFrame
    log: DataFrame
    gone: DataFrame | None = None


def new_story_rows(rows: DataFrame, now, name, last_article_at=None, description=None) -> DataFrame:
    null = F.lit(None)
    return rows.select(
        "id", name.alias("name"), (null if description is None else description).cast("string").alias("description"),
        F.lit("active").alias("status"), now_col(now).alias("created_at"),
        (null if last_article_at is None else last_article_at).cast("timestamp").alias("last_article_at"),
        null.cast("timestamp").alias("archived_at"), reset_expiry(now).alias("expires_at"),
    )


def _conform(fresh: DataFrame, table: DataFrame) -> DataFrame:
    """Only the columns the table has, so that older tables stay as they are."""
    return fresh.select(*[c for c in fresh.columns if c in table.columns])


def add_stories(stories: DataFrame, fresh: DataFrame) -> DataFrame:
    return stories.unionByName(_conform(fresh, stories), allowMissingColumns=True)


def apply_moves(articles: DataFrame, stories: DataFrame, moves: DataFrame, now) -> Applied:
    """Move (with ``from_event_id``) or add (without) articles to a story, or to a newly named one."""
    judged = lookup(moves, "article_id", articles, "id", current="event_id", published_date="published_date")
    judged = lookup(judged, "to_event_id", stories, "id", moves)
    is_add = F.col("from_event_id").isNull()
    name = non_empty(strip(F.col("new_name")))
    bad = (
        F.when(~F.col("has_article_id"), "no_article")
        .when(~is_add & ~F.col("current").eqNullSafe(F.col("from_event_id")), "wrong_source")
        .when(F.col("to_event_id").isNull() & (is_add | name.isNull()), "no_target")
        .when(F.col("to_event_id").isNotNull() & ~F.col("has_to_event_id"), "no_target")
    )
    judged = judged.withColumns({"bad": bad, "is_add": is_add, "story_name": name})
    judged = cut_lineage(judged)
    last = judged.filter(F.col("bad").isNull()).groupBy("article_id").agg(F.max("pos").alias("_last"))
    judged = judged.join(last, "article_id", "left").withColumn(
        "outcome", F.coalesce("bad", F.when(F.col("pos") == F.col("_last"), "applied").otherwise("superseded"))
    )
    winners = judged.filter(F.col("outcome") == "applied")
    named = with_new_ids(winners.filter(F.col("to_event_id").isNull()).select("pos", "story_name"), "pos", stories)
    placed = cut_lineage(winners.join(named.select("pos", F.col("id").alias("_new_id")), "pos", "left").withColumn("target", F.coalesce("to_event_id", "_new_id")))
    named = placed.filter(F.col("to_event_id").isNull()).select(F.col("target").alias("id"), "story_name")

    article_changes = placed.select(F.col("article_id").alias("id"), F.col("target").alias("event_id"), now_col(now).alias("grouped_at"))
    # Adds also move the story's date forward and activate it.
    added = F.col("is_add")
    per_story = placed.filter(F.col("to_event_id").isNotNull()).groupBy(F.col("target").alias("id")).agg(
        F.max(F.when(added, F.col("published_date"))).alias("_newest"),
        F.min_by(F.coalesce("published_date", now_col(now)), F.when(added, F.col("pos"))).alias("_first"),
        F.max(added).alias("_added"),
    )
    current = stories.join(per_story, "id")
    moved_on = F.greatest(F.coalesce("last_article_at", "_first"), F.col("_newest"))
    story_changes = current.select(
        "id", F.when(F.col("_added"), moved_on).otherwise(F.col("last_article_at")).alias("last_article_at"),
        F.when(F.col("_added"), F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_added"), F.lit(None)).otherwise(F.col("archived_at")).alias("archived_at"),
        reset_expiry(now).alias("expires_at"),
    )
    fresh = new_story_rows(named, now, F.col("story_name"))
    feedback = feedback_rows(placed, "move", now_col(now), article=F.col("article_id"), original=F.coalesce("from_event_id", "current"), corrected=F.col("target"), note=F.col("note"))
    return Applied(change_rows(articles, article_changes), add_stories(change_rows(stories, story_changes), fresh), feedback, judged.select("pos", "outcome"))


def apply_removals(articles: DataFrame, stories: DataFrame, summaries: DataFrame, removals: DataFrame, now) -> tuple[Applied, DataFrame]:
    """Take articles out of stories; a story left with fewer than two is disbanded.

    Several removals from one story count together.  Also returns the summaries that stay.
    """
    judged = lookup(removals, "article_id", articles, "id", current="event_id")
    judged = lookup(judged, "event_id", stories, "id", removals)
    fit = judged.filter(F.col("has_event_id") & (F.col("current") == F.col("event_id")))
    valid = cut_lineage(fit.groupBy("event_id", "article_id").agg(F.min("pos").alias("pos")))
    log = removals.select("pos").join(valid.select("pos", F.lit("removed").alias("outcome")), "pos", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_in_story")))
    removed = valid.groupBy("event_id").agg(F.count("*").alias("_removed"))
    disbanded = (
        story_article_counts(articles).join(removed, "event_id").filter(F.col("article_count") - F.col("_removed") < 2)
        .select(F.col("event_id").alias("id"))
    )
    disbanded = cut_lineage(disbanded)
    out = valid.select(F.col("article_id").alias("id"), F.lit(True).alias("_out"))
    dead = disbanded.select(F.col("id").alias("event_id"), F.lit(True).alias("_dead"))
    free = F.coalesce(F.col("_out") | F.col("_dead"), F.col("_out"), F.col("_dead"), F.lit(False))
    marked = left_by_story(articles.join(out, "id", "left"), dead).withColumn("_free", free)
    cleared = marked.withColumns({
        "event_id": F.when(F.col("_free"), F.lit(None)).otherwise(F.col("event_id")),
        "proposed_event_name": F.when(F.col("_free"), F.lit(None)).otherwise(F.col("proposed_event_name")),
        "grouped_at": F.when(F.col("_free"), now_col(now)).otherwise(F.col("grouped_at") if "grouped_at" in articles.columns else F.lit(None)),
    }).drop("_free", "_out", "_dead")
    feedback = feedback_rows(valid, "move", now_col(now), article=F.col("article_id"), original=F.col("event_id"))
    applied = Applied(cleared, delete_rows(stories, disbanded), feedback, log, disbanded)
    return applied, delete_rows(summaries, disbanded, "event_id", "id")


def apply_merges_manual(articles: DataFrame, stories: DataFrame, merges: DataFrame, now) -> Applied:
    """Merge stories in request order; the surviving story keeps its dates and status."""
    judged = lookup(lookup(merges, "primary_id", stories, "id"), "secondary_id", stories, "id", merges)
    fit = judged.filter(F.col("has_primary_id") & F.col("has_secondary_id") & (F.col("primary_id") != F.col("secondary_id")))
    decided = accept_in_order(fit.select("pos", F.col("primary_id").alias("keep"), F.col("secondary_id").alias("drop")))
    accepted = decided.filter("accepted").join(merges.select("pos", "note"), "pos")
    merged = merge_stories(articles, stories, accepted.select("pos", "keep", "drop", "note"), now, kind="merge", refresh=False, note=F.col("note"))
    outcome = (
        F.when(F.col("primary_id") == F.col("secondary_id"), "self_merge")
        .when(F.col("_ok").isNotNull(), "merged").otherwise("no_story")
    )
    log = merges.join(accepted.select("pos", F.lit(True).alias("_ok")), "pos", "left").select("pos", outcome.alias("outcome"))
    return Applied(merged.articles, merged.stories, merged.feedback, log, merged.dropped)


def apply_splits(articles: DataFrame, stories: DataFrame, splits: DataFrame, now) -> Applied:
    """Split articles out into newly named stories.

    ``splits`` has one row per (request, article): pos, event_id, new_name,
    note, article_id.  An article named twice goes with the first request.
    """
    heads = splits.groupBy("pos").agg(*[F.first(c).alias(c) for c in ("event_id", "new_name", "note")])
    heads = lookup(heads, "event_id", stories, "id", parent_name="name")
    name = non_empty(strip(F.col("new_name")))
    heads = heads.withColumn("outcome", F.when(~F.col("has_event_id"), "no_story").when(name.isNull(), "no_name").otherwise("split"))
    heads = cut_lineage(heads)
    valid = cut_lineage(with_new_ids(heads.filter(F.col("outcome") == "split").withColumn("story_name", name), "pos", stories))
    asked = splits.join(valid.select("pos", F.col("id").alias("target")), "pos").select("pos", "event_id", "article_id", "target")
    placed = lookup(asked, "article_id", articles, "id", current="event_id", published_date="published_date")
    placed = cut_lineage(placed.filter(F.col("current") == F.col("event_id")).groupBy("article_id").agg(
        F.min_by("target", "pos").alias("target"), F.first("published_date").alias("published_date")
    ))
    dates = placed.groupBy(F.col("target").alias("id")).agg(F.coalesce(F.max("published_date"), now_col(now)).alias("last_article_at"))
    fresh = new_story_rows(valid.join(dates, "id", "left"), now, F.col("story_name"), F.col("last_article_at"))
    default_note = F.concat(F.lit("split out '"), F.col("story_name"), F.lit("' from '"), F.col("parent_name"), F.lit("'"))
    feedback = feedback_rows(valid, "split", now_col(now), original=F.col("event_id"), corrected=F.col("id"), note=F.coalesce(non_empty(F.col("note")), default_note))
    changes = placed.select(F.col("article_id").alias("id"), F.col("target").alias("event_id"))
    return Applied(change_rows(articles, changes), add_stories(stories, fresh), feedback, heads.select("pos", "outcome"))


STATUSES = ["active", "cooling", "archived"]


def apply_story_changes(articles: DataFrame, stories: DataFrame, changes: DataFrame, now) -> Applied:
    """Create, rename, describe, set status, delete.  The last given value of a field wins."""
    judged = lookup(changes, "event_id", stories, "id")
    outcome = (
        F.when(F.col("op") == "create", F.when(non_empty(strip(F.col("name"))).isNull(), "no_name").otherwise("created"))
        .when(~F.col("has_event_id"), "no_story")
        .when(F.col("op") == "delete", "deleted")
        .when(F.col("status").isNotNull() & ~F.col("status").isin(STATUSES), "bad_status")
        .otherwise("updated")
    )
    judged = cut_lineage(judged.withColumn("outcome", outcome))
    given = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    stamps = F.when(F.col("status").isin("active", "archived"), F.col("pos"))
    edits = judged.filter(F.col("outcome") == "updated").groupBy(F.col("event_id").alias("id")).agg(
        F.max_by(strip(F.col("name")), given("name")).alias("_name"),
        F.max_by("description", given("description")).alias("_description"),
        F.max_by("status", given("status")).alias("_status"),
        F.max_by("status", stamps).alias("_stamp"),
    )
    joined = stories.join(edits, "id", "left")
    stamped = F.when(F.col("_stamp") == "archived", now_col(now)).when(F.col("_stamp") == "active", F.lit(None)).otherwise(F.col("archived_at"))
    columns = {"name": F.coalesce("_name", "name"), "status": F.coalesce("_status", "status"), "archived_at": stamped}
    if "description" in stories.columns:
        columns["description"] = F.coalesce("_description", "description")
    edited = joined.withColumns(columns).drop("_name", "_description", "_status", "_stamp")
    gone = judged.filter(F.col("outcome") == "deleted").select(F.col("event_id").alias("id")).distinct()
    created = with_new_ids(judged.filter(F.col("outcome") == "created").select("pos", "name", "description"), "pos", stories)
    fresh = new_story_rows(created, now, strip(F.col("name")), description=F.col("description"))
    dead = gone.select(F.col("id").alias("event_id"), F.lit(True).alias("_dead"))
    freed = left_by_story(articles, dead).withColumns({
        "event_id": F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("event_id")),
        "grouped_at": F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("grouped_at") if "grouped_at" in articles.columns else F.lit(None)).cast("timestamp"),
    }).drop("_dead")
    feedback = feedback_rows(judged.limit(0), "move", now_col(now))
    return Applied(freed, add_stories(delete_rows(edited, gone), fresh), feedback, judged.select("pos", "outcome"), gone)


def apply_feed_changes(feeds: DataFrame, articles: DataFrame, changes: DataFrame, now, interval_minutes: int = DEFAULTS.fetch_interval_minutes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add, re-time, pause, unpause and remove feeds: (feeds, articles, log)."""
    address = strip(F.col("url"))
    adds = changes.filter(F.col("op") == "add").withColumn("url", address)
    web = F.coalesce(adds["url"].rlike("^https?://"), F.lit(False))
    good = adds.filter(web)
    known = feeds.select("url", F.col("id").alias("known_id"))
    asked = good.groupBy("url").agg(
        F.min_by("name", "pos").alias("name"), F.max_by("fetch_interval_minutes", F.when(F.col("fetch_interval_minutes").isNotNull(), F.col("pos"))).alias("minutes"),
        F.max("pos").alias("pos"),
    ).join(known, "url", "left")
    created = with_new_ids(asked.filter(F.col("known_id").isNull()), "url", feeds).select(
        "id", "url", F.coalesce(non_empty(F.col("name")), host_name(F.col("url"))).alias("name"),
        F.coalesce("minutes", F.lit(interval_minutes)).alias("fetch_interval_minutes"), F.lit(None).cast("timestamp").alias("last_fetched_at"),
        now_col(now).alias("created_at"), F.lit(False).alias("is_paused"),
    )
    edits = lookup(changes.filter(F.col("op") != "add"), "feed_id", feeds, "id")
    valid = edits.filter("has_feed_id")
    retimed = valid.filter(F.col("op") == "interval").select("pos", F.col("feed_id").alias("id"), "op", F.col("fetch_interval_minutes").alias("minutes"))
    re_added = asked.filter(F.col("known_id").isNotNull() & F.col("minutes").isNotNull()).select("pos", F.col("known_id").alias("id"), F.lit("interval").alias("op"), "minutes")
    toggles = valid.filter(F.col("op").isin("pause", "unpause")).select("pos", F.col("feed_id").alias("id"), "op", F.lit(None).cast("int").alias("minutes"))
    merged = retimed.unionByName(re_added).unionByName(toggles).groupBy("id").agg(
        F.max_by("minutes", F.when(F.col("op") == "interval", F.col("pos"))).alias("_minutes"),
        F.max_by("op", F.when(F.col("op") != "interval", F.col("pos"))).alias("_toggle"),
    )
    removed = valid.filter(F.col("op") == "remove").select(F.col("feed_id").alias("id")).distinct()
    edited = feeds.join(merged, "id", "left").withColumns({
        "fetch_interval_minutes": F.coalesce("_minutes", "fetch_interval_minutes"),
        "is_paused": F.when(F.col("_toggle").isNotNull(), F.col("_toggle") == "pause").otherwise(F.coalesce("is_paused", F.lit(False))),
    }).drop("_minutes", "_toggle")
    kept = delete_rows(edited, removed).unionByName(_conform(created, feeds), allowMissingColumns=True)
    dead = removed.select(F.col("id").alias("feed_source_id"), F.lit(True).alias("_dead"))
    freed = articles.join(dead, "feed_source_id", "left").withColumn(
        "feed_source_id", F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("feed_source_id"))
    ).drop("_dead")
    log_adds = adds.select("pos", F.when(web, "added").otherwise("bad_url").alias("outcome"))
    log_edits = edits.select("pos", F.when(F.col("has_feed_id"), F.col("op")).otherwise("no_feed").alias("outcome"))
    return kept, freed, log_adds.unionByName(log_edits)


def disband_same_source(articles: DataFrame, stories: DataFrame, summaries: DataFrame, now) -> tuple[Applied, DataFrame]:
    """Dissolve small one-publisher stories; their name stays as a suggestion on the articles."""
    targets = same_source_stories(articles).join(stories.select(F.col("id").alias("event_id"), F.col("name").alias("_name")), "event_id")
    gone = targets.select(F.col("event_id").alias("id"))
    marked = left_by_story(articles, targets.select("event_id", "_name", F.lit(True).alias("_dead")))
    freed = marked.withColumns({
        "proposed_event_name": F.when(F.col("_dead"), F.col("_name")).otherwise(F.col("proposed_event_name")),
        "grouped_at": F.when(F.col("_dead"), now_col(now)).otherwise(F.col("grouped_at") if "grouped_at" in articles.columns else F.lit(None)),
        "event_id": F.when(F.col("_dead"), F.lit(None)).otherwise(F.col("event_id")),
    }).drop("_dead", "_name")
    log = targets.select("event_id", "article_count", F.lit("disbanded").alias("outcome"))
    feedback = feedback_rows(targets.limit(0), "move", now_col(now))
    return Applied(freed, delete_rows(stories, gone), feedback, log, gone), delete_rows(summaries, gone, "event_id", "id")


def append_chat_turns(messages: DataFrame, stories: DataFrame, turns: DataFrame, now) -> DataFrame:
    """Question and answer rows of complete turns on known stories."""
    question, answer = strip(F.col("question")), strip(F.col("answer"))
    complete = turns.filter((F.coalesce(question, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != ""))
    complete = complete.join(stories.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    pair = F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content"), F.lit(None).cast("string").alias("model_used")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content"), F.col("model_used").alias("model_used")),
    )
    rows = complete.select("pos", "event_id", "visitor_id", F.explode(pair).alias("m")).select(
        F.concat_ws(":", "pos", F.col("m.role")).alias("_key"), "event_id", "visitor_id", "m.role", "m.content", "m.model_used", now_col(now).alias("created_at")
    )
    return messages.unionByName(with_new_ids(rows, "_key", messages).drop("_key"), allowMissingColumns=True)


# --- visitor state -----------------------------------------------------------


def mark_read(reads: DataFrame, articles: DataFrame, requests: DataFrame) -> DataFrame:
    """Add missing reads of known articles; the first read time stays."""
    wanted = requests.groupBy("visitor_id", "article_id").agg(F.min_by("at", "pos").alias("read_at"))
    known = lookup(wanted, "article_id", articles, "id").filter("has_article_id").drop("has_article_id")
    fresh = not_stored(known.select("visitor_id", "article_id", "read_at"), reads, ["visitor_id", "article_id"])
    return reads.unionByName(fresh, allowMissingColumns=True)


def mark_unread(reads: DataFrame, requests: DataFrame) -> DataFrame:
    return reads.join(requests.select("visitor_id", "article_id").distinct(), ["visitor_id", "article_id"], "left_anti")


#: Articles of a story that meet a request as one row, about.
READ_BLOCK = 4096


def mark_all_read(reads: DataFrame, articles: DataFrame, requests: DataFrame, now, block: int = READ_BLOCK) -> DataFrame:
    """Reads to add so that every article of the asked stories is read: the marked ids.

    A request stands for all articles of its story, so the pairs come last and are never moved: a story's
    article ids are dealt by hash into blocks of about ``block``, and requests, with what the visitor has
    read of a block, meet whole blocks.
    """
    asked = requests.select("visitor_id", "event_id").distinct()
    members = grouped(articles).select("event_id", F.col("id").alias("article_id"))
    sizes = members.groupBy("event_id").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    placed = left_join_sliced(members, sizes, "event_id", "article_id")
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("article_id"), "_blocks")).drop("_blocks")
    # A null id is a row like any other, but would not be collected by itself.
    blocks = placed.groupBy("event_id", "_block").agg(F.collect_list(F.struct("article_id")).alias("_articles"))
    # Reads of other visitors than those who ask do not take part.
    theirs = reads.join(asked.select("visitor_id").distinct(), "visitor_id", "left_semi")
    seen = theirs.select("visitor_id", "article_id").join(placed, "article_id")
    seen = seen.groupBy("visitor_id", "event_id", "_block").agg(F.collect_set("article_id").alias("_seen"))
    wanted = asked.join(sizes, "event_id").select("visitor_id", "event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    pairs = wanted.join(seen, ["visitor_id", "event_id", "_block"], "left").join(blocks, ["event_id", "_block"])
    pairs = pairs.select("visitor_id", "event_id", "_seen", F.explode("_articles.article_id").alias("article_id"))
    missing = pairs.filter(~F.coalesce(F.array_contains("_seen", F.col("article_id")), F.lit(False)))
    return missing.select("visitor_id", "article_id", "event_id", now_col(now).alias("read_at"))


def mark_visited(visits: DataFrame, stories: DataFrame, requests: DataFrame) -> DataFrame:
    known = requests.join(stories.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    fresh = known.select("visitor_id", "event_id", F.col("at").alias("last_visited_at"))
    return visits.unionByName(fresh).groupBy("visitor_id", "event_id").agg(F.max("last_visited_at").alias("last_visited_at"))


