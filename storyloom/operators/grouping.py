"""Attaching articles to stories from a table of decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.answers import zero_as
from storyloom.functions.text import non_empty, normalize_event_name, strip
from storyloom.operators.corrections import add_stories, new_story_rows
from storyloom.operators.ids import with_new_ids
from storyloom.operators.lifecycle import reset_expiry
from storyloom.operators.rank import newest_first
from storyloom.operators.rollups import ago, distinct_source_check, now_col
from storyloom.operators.updates import change_rows, lookup
from storyloom.session import cut_lineage
from storyloom.settings import DEFAULTS


def ungrouped(articles: DataFrame, limit: int | None = None) -> DataFrame:
    rows = articles.filter(F.col("event_id").isNull()).orderBy(*newest_first())
    return rows.limit(limit) if limit else rows


def assignable_stories(stories: DataFrame) -> DataFrame:
    return stories.filter(F.col("status").isin("active", "cooling")).orderBy(F.desc_nulls_last("last_article_at"), F.asc("id"))


def find_or_create(names: DataFrame, stories: DataFrame, now, window_days: int = DEFAULTS.revive_window_days) -> DataFrame:
    """Story of every normalised name: ``names`` has (norm, story_name), one row per norm.

    Active stories and those archived within the window match, the oldest
    first.  Adds id and outcome ``created``, ``reused`` or ``revived``.
    """
    matchable = stories.filter(
        (F.col("status") == "active") | ((F.col("status") == "archived") & (F.col("archived_at") >= ago(now, days=window_days)))
    )
    oldest = matchable.select(normalize_event_name(F.col("name")).alias("norm"), F.struct("created_at", "id", "status").alias("s"))
    best = oldest.filter(F.col("norm") != "").groupBy("norm").agg(F.min("s").alias("s"))
    matched = names.join(best, "norm", "left")
    found = matched.filter(F.col("s").isNotNull()).select(
        "norm", "story_name", F.col("s.id").alias("id"), F.when(F.col("s.status") == "archived", "revived").otherwise("reused").alias("outcome")
    )
    missing = matched.filter(F.col("s").isNull()).select("norm", "story_name")
    created = with_new_ids(missing, "norm", stories).select("norm", "story_name", "id", F.lit("created").alias("outcome"))
    return found.unionByName(created)


@dataclass(frozen=True)
class Grouped:
    """New tables, one outcome per decision or cluster, and the (story, article) attachments."""

    articles: DataFrame
    stories: DataFrame
    log: DataFrame
    attached: DataFrame


def _judged(decisions: DataFrame, articles: DataFrame, stories: DataFrame) -> DataFrame:
    rows = decisions.select(
        "pos", "article_id", "decision", F.when(F.col("decision") == "existing", F.col("event_id")).alias("event_id"),
        non_empty(strip(F.col("event_name"))).alias("story_name"),
        zero_as(F.col("importance_score"), 0.5).alias("importance"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    rows = lookup(rows, "article_id", articles, "id", decisions, published_date="published_date", publisher_name="publisher_name")
    return lookup(rows, "event_id", stories, "id", decisions)


def _last_per_article(rows: DataFrame, *order: str) -> DataFrame:
    """The row whose effect stays when an article was decided more than once."""
    packed = F.max_by(F.struct(*[c for c in rows.columns if c != "article_id"]), F.struct(*order))
    return rows.groupBy("article_id").agg(packed.alias("r")).select("article_id", "r.*")


def _article_changes(last: DataFrame, articles: DataFrame, now) -> DataFrame:
    """Columns an article takes from its last decision.

    Attached: story, importance, confidence, no suggestion.  Suggested: the
    name, importance, confidence.  Uncategorised: confidence, no suggestion.
    """
    old = articles.join(last.select(F.col("article_id").alias("id")), "id", "left_semi").select("id", "event_id", "importance_score")
    joined = last.withColumnRenamed("article_id", "id").join(old, "id")
    effect = F.col("effect")
    return joined.select(
        "id",
        F.when(effect == "attach", F.col("target")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(effect == "suggest", F.col("story_name")).alias("proposed_event_name"),
        F.when(effect == "uncategorize", F.col("importance_score")).otherwise(F.col("importance")).alias("importance_score"),
        F.col("confidence").alias("grouping_confidence"),
        now_col(now).alias("grouped_at"),
    )


def _touch_stories(stories: DataFrame, attached: DataFrame, anchors: DataFrame | None, now) -> DataFrame:
    """Attached stories become active with a full period; dates only move forward.

    A story without a date takes the date of its first article that ``starts``, or ``now``.
    ``anchors`` adds (id, anchor) dates that count whatever their order.
    """
    moved = attached.groupBy(F.col("target").alias("id")).agg(
        F.max("published_date").alias("_newest"),
        F.min_by(F.coalesce("published_date", now_col(now)), F.when(F.col("starts"), F.col("pos"))).alias("_first"),
    )
    if anchors is not None:
        moved = moved.join(anchors.groupBy("id").agg(F.max("anchor").alias("_anchor")), "id", "left")
    else:
        moved = moved.withColumn("_anchor", F.lit(None).cast("timestamp"))
    changes = stories.select("id", "last_article_at").join(moved, "id").select(
        "id", F.greatest(F.coalesce("last_article_at", F.greatest("_first", "_anchor")), F.col("_newest"), F.col("_anchor")).alias("last_article_at"),
        F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("archived_at"), reset_expiry(now).alias("expires_at"),
    )
    return change_rows(stories, changes)


def _error_or(outcome: Column) -> Column:
    return (
        F.when(~F.col("has_article_id"), "errors")
        .when((F.col("decision") == "existing") & ~F.col("has_event_id"), "errors")
        .when((F.col("decision") == "new") & F.col("story_name").isNull(), "errors")
        .when(F.col("decision").isin("existing", "new", "uncategorized"), outcome)
        .otherwise("errors")
    )


def apply_live(articles: DataFrame, stories: DataFrame, decisions: DataFrame, now, require_distinct: bool = DEFAULTS.require_distinct_sources) -> Grouped:
    """Apply decisions of the live pass.

    With distinct sources required a lone article never founds a story; its
    proposed name is kept as a suggestion.  Otherwise a name finds or creates
    its story; names meet the stories as they stand at the start of the batch.
    """
    judged = _judged(decisions, articles, stories)
    kind = F.when(F.col("decision") == "new", "singleton" if require_distinct else "named").otherwise(F.col("decision"))
    judged = cut_lineage(judged.withColumn("outcome", _error_or(kind)))
    named = judged.filter(F.col("outcome") == "named").withColumn("norm", normalize_event_name(F.col("story_name")))
    if require_distinct:
        placed = judged.withColumn("target", F.col("event_id"))
        homes = None
    else:
        names = named.groupBy("norm").agg(F.min_by("story_name", "pos").alias("story_name"), F.min("pos").alias("first_pos"))
        homes = cut_lineage(find_or_create(names.select("norm", "story_name"), stories, now).join(names.select("norm", "first_pos"), "norm"))
        keyed = judged.withColumn("norm", F.when(F.col("outcome") == "named", normalize_event_name(F.col("story_name"))).otherwise(F.concat(F.lit("\u0000"), F.col("pos"))))
        placed = keyed.join(homes.select("norm", F.col("id").alias("_home"), F.col("outcome").alias("_how"), "first_pos"), "norm", "left").withColumns({
            "target": F.coalesce("_home", "event_id"),
            # The first article meets the name as it was, the others find the story in use.
            "outcome": F.when(F.col("_home").isNull(), F.col("outcome"))
            .when((F.col("pos") == F.col("first_pos")) & (F.col("_how") == "created"), "new")
            .when((F.col("pos") == F.col("first_pos")) & (F.col("_how") == "revived"), "revived").otherwise("reused"),
        })
    effect = (
        F.when(F.col("outcome").isin("existing", "new", "reused", "revived"), "attach")
        .when(F.col("outcome") == "singleton", "suggest").when(F.col("outcome") == "uncategorized", "uncategorize")
    )
    placed = placed.withColumn("effect", effect)
    last = _last_per_article(
        placed.filter(F.col("effect").isNotNull()).select("article_id", "pos", "effect", "target", "story_name", "importance", "confidence"), "pos"
    )
    attached = placed.filter(F.col("effect") == "attach").select("pos", "article_id", "target", "published_date", "outcome", F.lit(True).alias("starts"))
    known, anchors = stories, None
    if homes is not None:
        starts = attached.filter(F.col("outcome") != "existing").select(F.col("target").alias("id"), F.coalesce("published_date", now_col(now)).alias("anchor"))
        anchors = starts
        known = add_stories(stories, new_story_rows(homes.filter(F.col("outcome") == "created"), now, F.col("story_name")))
    return Grouped(
        change_rows(articles, _article_changes(last, articles, now)), _touch_stories(known, attached, anchors, now),
        placed.select("pos", "outcome"),
        # Only plain attachments ask for a summary in the live pass.
        attached.filter(F.col("outcome") == "existing").select(F.col("target").alias("event_id"), "article_id", F.lit(False).alias("created")),
    )


def apply_regroup(articles: DataFrame, stories: DataFrame, decisions: DataFrame, now, require_distinct: bool = DEFAULTS.require_distinct_sources) -> Grouped:
    """Apply decisions of the forced pass, the only one that founds stories.

    ``new`` decisions with the same trimmed name form a cluster.  Two or more
    decisions from two publishers found (or find) a story and all its articles
    attach; any other cluster becomes a suggestion on its articles.  The log
    has one row per plain decision and one per cluster.
    """
    kind = F.when(F.col("decision") == "new", "clustered").otherwise(F.col("decision"))
    judged = _judged(decisions, articles, stories)
    judged = cut_lineage(judged.withColumn("outcome", _error_or(kind)))
    # Sizes count decisions, also those whose article is unknown.
    members = judged.filter((F.col("decision") == "new") & F.col("story_name").isNotNull())
    sizes = members.groupBy("story_name").agg(
        F.count("*").alias("size"), F.min("pos").alias("first_pos"), F.min_by("has_article_id", "pos").alias("first_known"),
        F.min_by(F.coalesce("published_date", now_col(now)), "pos").alias("anchor"),
    )
    sources = distinct_source_check(members.filter("has_article_id"), "story_name", required=require_distinct)
    clusters = sizes.join(sources, "story_name", "left").withColumn(
        "verdict",
        F.when(F.col("size") < 2, "new_singletons").when(~F.col("first_known"), "errors")
        .when(~F.coalesce("distinct_sources", F.lit(not require_distinct)), "new_singletons").otherwise("founding"),
    ).withColumn("norm", normalize_event_name(F.col("story_name")))
    clusters = cut_lineage(clusters)
    founding = clusters.filter(F.col("verdict") == "founding")
    names = founding.groupBy("norm").agg(F.min_by("story_name", "first_pos").alias("story_name"), F.min("first_pos").alias("norm_first"))
    homes = cut_lineage(find_or_create(names.select("norm", "story_name"), stories, now).join(names.select("norm", "norm_first"), "norm"))
    settled = clusters.join(homes.select("norm", F.col("id").alias("home"), F.col("outcome").alias("how"), "norm_first"), "norm", "left").withColumn(
        "verdict",
        F.when(F.col("verdict") != "founding", F.col("verdict"))
        .when((F.col("first_pos") == F.col("norm_first")) & (F.col("how") == "created"), "new_events")
        .when((F.col("first_pos") == F.col("norm_first")) & (F.col("how") == "revived"), "revived").otherwise("reused"),
    )
    settled = cut_lineage(settled.select("story_name", "verdict", "home", "anchor", "first_pos"))
    in_cluster = members.filter("has_article_id").join(settled, "story_name")
    clustered = in_cluster.filter(F.col("verdict") != "errors").select(
        "pos", "article_id", "published_date", "story_name", "importance", "confidence", F.col("home").alias("target"),
        F.when(F.col("verdict") == "new_singletons", "suggest").otherwise("attach").alias("effect"),
        F.lit(1).alias("phase"), "first_pos", F.col("verdict").alias("outcome"),
    )
    plain = judged.filter(F.col("outcome").isin("existing", "uncategorized")).select(
        "pos", "article_id", "published_date", "story_name", "importance", "confidence", F.col("event_id").alias("target"),
        F.when(F.col("outcome") == "existing", "attach").otherwise("uncategorize").alias("effect"),
        F.lit(0).alias("phase"), F.lit(0).cast("long").alias("first_pos"), "outcome",
    )
    effects = cut_lineage(plain.unionByName(clustered))
    last = _last_per_article(
        effects.select("article_id", "phase", "first_pos", "pos", "effect", "target", "story_name", "importance", "confidence"), "phase", "first_pos", "pos"
    )
    attached = effects.filter(F.col("effect") == "attach")
    anchors = settled.filter(F.col("home").isNotNull()).select(F.col("home").alias("id"), "anchor")
    known = add_stories(stories, new_story_rows(homes.filter(F.col("outcome") == "created"), now, F.col("story_name")))
    log = judged.filter(F.col("outcome") != "clustered").select("pos", "outcome").unionByName(
        settled.select(F.col("first_pos").alias("pos"), F.col("verdict").alias("outcome"))
    )
    created = homes.filter(F.col("outcome") == "created").select(F.col("id").alias("target"), F.lit(True).alias("created"))
    return Grouped(
        change_rows(articles, _article_changes(last, articles, now)),
        _touch_stories(known, attached.select("target", "published_date", "pos", (F.col("phase") == 0).alias("starts")), anchors, now), log,
        attached.join(created, "target", "left").select(F.col("target").alias("event_id"), "article_id", F.coalesce("created", F.lit(False)).alias("created")),
    )


def summary_targets(result: Grouped) -> DataFrame:
    """Stories that need a summary: founded ones a first one, others an update with their new articles.

    One row per (story, new article), so a story may gain any number of articles.
    """
    kind = F.when(F.col("created"), "initial").otherwise("incremental")
    return result.attached.select("event_id", "article_id", kind.alias("kind")).distinct()
