"""Inputs of the model calls, as rows.

A story's input is the texts of its article rows in the order given by the
sort columns.  It stays rows, sorted by range over the cluster: one story may
hold a third of all articles, which no single string or task could carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import schemas
from storyloom.functions.answers import answer_lists, as_id, as_object, elements, parse_exact, recover_summary, summary_block
from storyloom.functions.dates import iso_text
from storyloom.functions.text import classify_title, non_empty, snippet, strip_code_fence, truncate_ellipsis
from storyloom.operators import rank
from storyloom.operators.rollups import ago, grouped, now_col
from storyloom.settings import DEFAULTS

LIVE_SNIPPET = 500
RECLUSTER_SNIPPET = 300
# Fixed value: what stands for a missing text.
NO_CONTENT = "No content available."


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def story_payload(stories: DataFrame, articles: DataFrame, titles: int = 5) -> DataFrame:
    """One JSON line per story: id, name, description, date, newest titles."""
    recent = rank.recent_titles(articles, titles).withColumnRenamed("event_id", "id")
    description = F.col("description") if "description" in stories.columns else F.lit(None).cast("string")
    return stories.join(recent, "id", "left").select(
        F.col("status").alias("section"), "id",
        _json(
            F.col("id"), F.col("name"), description.alias("description"), iso_text(F.col("last_article_at")).alias("last_article_at"),
            F.coalesce("recent_titles", F.array().cast("array<string>")).alias("recent_titles"),
        ).alias("line"),
    )


def article_payload(articles: DataFrame, chars: int, typed: bool = True) -> DataFrame:
    """One JSON line per article; the type hint is only for the grouping passes."""
    hint = [classify_title(F.col("title")).alias("content_type")] if typed else []
    return articles.select(
        F.lit("article").alias("section"), "id",
        _json(
            F.col("id"), F.col("title"), F.col("publisher_name").alias("source"), iso_text(F.col("published_date")).alias("published_date"),
            snippet(F.col("scraped_text_content"), F.col("rss_description"), chars).alias("snippet"), *hint,
        ).alias("line"),
    )


def group_payload(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """Lines for the grouping pass: active and cooling stories, then ungrouped articles."""
    open_stories = stories.filter(F.col("status").isin("active", "cooling"))
    waiting = articles.filter(F.col("event_id").isNull())
    return story_payload(open_stories, articles).unionByName(article_payload(waiting, LIVE_SNIPPET))


def recluster_window(
    articles: DataFrame, stories: DataFrame, now, revive_days: int = DEFAULTS.revive_window_days,
    recent_days: int = DEFAULTS.recluster_days, limit: int | None = DEFAULTS.recluster_limit,
) -> DataFrame:
    """What the recluster pass looks at, tagged by section."""
    seen = F.col("status").isin("active", "cooling") | ((F.col("status") == "archived") & (F.col("archived_at") >= ago(now, days=revive_days)))
    kept = stories.filter(seen).select(F.col("status").alias("section"), "id")
    fresh = articles.filter(F.col("event_id").isNull() & (F.col("published_date") >= ago(now, days=recent_days))).select("id", "published_date").orderBy(*rank.newest_first())
    fresh = fresh.limit(limit) if limit else fresh
    return kept.unionByName(fresh.select(F.lit("unassigned").alias("section"), "id"))


def recluster_payload(articles: DataFrame, stories: DataFrame, now, **bounds) -> DataFrame:
    """Lines for the recluster pass; ``bounds`` are those of ``recluster_window``."""
    window = recluster_window(articles, stories, now, **bounds)
    chosen = stories.join(window.filter(F.col("section") != "unassigned").select("id"), "id", "left_semi")
    fresh = articles.join(window.filter(F.col("section") == "unassigned").select("id"), "id", "left_semi")
    return story_payload(chosen, articles).unionByName(article_payload(fresh, RECLUSTER_SNIPPET, typed=False))


def _first_per_url(keys: DataFrame) -> DataFrame:
    """Newest article per (story, address); the cut is made on keys, texts join later."""
    return rank.first_per(keys, ["event_id", "url"], rank.newest_first()).drop("rn")


def _summary_text() -> Column:
    content = F.coalesce(non_empty(F.col("scraped_text_content")), non_empty(F.col("rss_description")), F.lit(NO_CONTENT))
    return F.concat(
        F.lit("--- Article ---\nTitle: "), F.coalesce("title", F.lit("None")), F.lit("\nSource: "), F.coalesce("publisher_name", F.lit("None")),
        F.lit(" ("), F.coalesce(iso_text(F.col("published_date")), F.lit("None")), F.lit(")\nURL: "), F.coalesce("url", F.lit("None")),
        F.lit("\nContent: "), content, F.lit("\n"),
    )


def summary_payload(articles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Text block per article of every story (or of the ``wanted`` articles), newest first, one per address."""
    rows = grouped(articles)
    if wanted is not None:
        rows = rows.join(wanted.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    kept = _first_per_url(rows.select("event_id", "url", "published_date", "id")).select("id")
    blocks = rows.join(kept, "id", "left_semi").select("event_id", "published_date", "id", _summary_text().alias("block"))
    return blocks.orderBy("event_id", *rank.newest_first())


def incremental_payload(articles: DataFrame, summaries: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks for stories with new articles.

    A story with an earlier summary gets its new articles only; one without
    gets all its articles, as for a first summary.
    """
    prior = rank.latest_summary(summaries.select("event_id", "generated_at", "id", "summary_json")).filter(F.col("summary_json").isNotNull())
    prior = prior.select("event_id", F.col("id").alias("prior_id"))
    asked = targets.select("event_id").distinct().join(prior, "event_id", "left")
    new = targets.select("event_id", F.col("article_id").alias("id")).distinct().withColumn("_new", F.lit(True))
    rows = grouped(articles).join(asked, "event_id").join(new, ["event_id", "id"], "left")
    rows = rows.filter(F.col("prior_id").isNull() | F.col("_new"))
    kept = _first_per_url(rows.select("event_id", "url", "published_date", "id")).select("id")
    return rows.join(kept, "id", "left_semi").select("event_id", "prior_id", "published_date", "id", _summary_text().alias("block")).orderBy("event_id", *rank.newest_first())


def chat_blocks(articles: DataFrame, k: int = DEFAULTS.chat_articles, chars: int = DEFAULTS.chat_chars) -> DataFrame:
    """Text blocks of the newest articles of every story, one per address."""
    picked = rank.chat_context(articles, k).select("event_id", "id", "published_date", "position", "is_source")
    full = articles.join(picked.select("id", "position", "is_source"), "id")
    keyed = full.withColumn("_address", F.coalesce(non_empty(F.col("url")), F.col("id").cast("string")))
    first = rank.first_per(keyed, ["event_id", "_address"], [F.asc("position")]).drop("rn", "_address")
    content = F.coalesce(non_empty(F.col("scraped_text_content")), non_empty(F.col("rss_description")))
    text = F.coalesce(truncate_ellipsis(content, chars) if chars > 0 else content, F.lit(NO_CONTENT))
    block = F.concat(
        F.lit("--- "), F.coalesce(non_empty(F.col("title")), F.lit("Untitled")), F.lit(" ("), F.coalesce(non_empty(F.col("publisher_name")), F.lit("Unknown Source")),
        F.lit(", "), F.coalesce(iso_text(F.col("published_date")), F.lit("Unknown Date")), F.lit(") ---\n"), text, F.lit("\n"),
    )
    return first.select("event_id", "position", "id", "is_source", block.alias("block"))


def chat_payload(stories: DataFrame, articles: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per story one text of its newest few articles and one of its summary.

    At most ``chat_articles`` blocks of bounded length meet in one row.
    """
    blocks = chat_blocks(articles).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("_b"))
    joined = stories.select(F.col("id").alias("event_id"), "name").join(blocks, "event_id").join(summary_blocks(summaries), "event_id", "left")
    return joined.select(
        "event_id", "name",
        F.array_join(F.transform("_b", lambda b: b["block"]), "\n").alias("articles_block"),
        F.coalesce("summary_block", summary_block(F.lit(None).cast(schemas.SUMMARY))).alias("summary_block"),
    )


def parsed_summary(json_text: Column) -> Column:
    """Summary struct; an absent or empty object is null."""
    parsed = F.from_json(json_text, schemas.SUMMARY)
    return F.when(F.regexp_replace(json_text, r"\s", "") != "{}", parsed)


def summary_blocks(summaries: DataFrame) -> DataFrame:
    newest = rank.latest_summary(summaries.select("event_id", "generated_at", "id", "summary_json"))
    return newest.select("event_id", summary_block(parsed_summary(F.col("summary_json"))).alias("summary_block"))


def source_observations(summaries: DataFrame) -> DataFrame:
    """What each source is said to report, one row per observation."""
    entries = summaries.select("id", "event_id", F.posexplode(parsed_summary(F.col("summary_json"))["cross_source_synthesis"]["by_source"]).alias("place", "entry"))
    return entries.select("id", "event_id", "place", F.coalesce(non_empty(F.col("entry.source")), F.lit("Unknown")).alias("source"), F.col("entry.observation").alias("observation"))


UPDATE_PREFIX = "(Updates based on new articles) "


def summarised_articles(articles: DataFrame) -> DataFrame:
    """(event_id, article_id) of the articles a full summary is made of: the newest of each address."""
    return _first_per_url(grouped(articles).select("event_id", "url", "published_date", "id")).select("event_id", F.col("id").alias("article_id"))


def save_summary(
    summaries: DataFrame, stories: DataFrame, articles: DataFrame, answers: DataFrame, now, regenerated: bool = False,
    used: DataFrame | None = None, model: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Append parsed answers (event_id, summary_json) and stamp their stories: (summaries, stories).

    A regenerated summary marks its progressive text as an update where a
    prior summary existed.  ``used`` (event_id, article_id) are the articles
    the answers were made of, those of the full payload unless given; their
    number is the summary's, and ``summary_lineage`` lists them.
    """
    from storyloom.operators.ids import with_new_ids
    from storyloom.operators.updates import change_rows

    used = summarised_articles(articles) if used is None else used
    counts = used.groupBy("event_id").agg(F.count("*").cast("int").alias("article_count"))
    rows = answers.join(counts, "event_id", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))
    if regenerated:
        prior = summaries.filter(F.col("summary_json").isNotNull()).select("event_id", F.lit(True).alias("_prior")).distinct()
        parsed = F.from_json("summary_json", schemas.SUMMARY)
        marked = parsed.withField("progressive_summary", F.concat(F.lit(UPDATE_PREFIX), parsed["progressive_summary"]))
        text = F.when(F.col("_prior") & parsed["progressive_summary"].isNotNull(), F.to_json(marked)).otherwise(F.col("summary_json"))
        rows = rows.join(prior, "event_id", "left").withColumn("summary_json", text).drop("_prior")
    fresh = with_new_ids(rows, "event_id", summaries).select("id", "event_id", "summary_json", now_col(now).alias("generated_at"), "article_count", F.lit(model).cast("string").alias("model_used"))
    old = stories.select("id", F.col("summary_version") if "summary_version" in stories.columns else F.lit(None).cast("int").alias("summary_version"))
    changes = old.join(rows.select(F.col("event_id").alias("id"), "article_count"), "id").select(
        "id", now_col(now).alias("last_summary_at"), F.col("article_count").alias("summary_article_count"),
        (F.coalesce("summary_version", F.lit(0)) + 1).alias("summary_version"),
    )
    return summaries.unionByName(fresh, allowMissingColumns=True), change_rows(stories, changes)


def summary_lineage(saved: DataFrame, answers: DataFrame, used: DataFrame) -> DataFrame:
    """(summary_id, event_id, article_id) of the summaries just saved.

    The articles of a summary are rows: a story may hold more than fit one record.
    """
    newest = saved.join(answers.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.max("id").alias("summary_id"))
    return used.join(newest, "event_id").select("summary_id", "event_id", "article_id")


# --- reading answers ---------------------------------------------------------


def _items(responses: DataFrame, field: str) -> DataFrame:
    """(id, place, item) of one list of all answers.

    An answer or a list that can't be read gives one row without place and item; an answer without the
    list gives none.
    """
    parsed = responses.select("id", answer_lists(F.col("content"), [field])[field].alias("listed"), answer_lists(F.col("content"), [field]).isNull().alias("lost"))
    read = parsed.select("id", "lost", F.col("listed").isNotNull().alias("given"), elements(F.col("listed")).alias("items"))
    rows = read.select("id", F.posexplode_outer("items").alias("place", "item"), (F.col("lost") | (F.col("given") & F.col("items").isNull())).alias("lost"))
    return rows.filter(F.col("lost") | F.col("place").isNotNull()).drop("lost")


def parse_assignments(responses: DataFrame) -> DataFrame:
    """Rows of all answers; an answer or an element that can't be read gives one row with ``error``."""
    rows = _items(responses, "assignments").select("id", "place", as_object(F.col("item"), schemas.ASSIGNMENT).alias("a"))
    number = lambda c: F.col(f"a.{c}").try_cast("double")
    importance = number("importance_score")
    return rows.select(
        "id", "place", F.col("a").isNull().alias("error"), as_id(F.col("a.article_id")).alias("article_id"), F.col("a.decision").alias("decision"),
        as_id(F.col("a.event_id")).alias("event_id"), F.col("a.event_name").alias("event_name"),
        F.when(F.col("a").isNotNull(), F.when(importance.isNull() | (importance == 0), F.lit(0.5)).otherwise(importance)).alias("importance_score"),
        F.when(F.col("a").isNotNull(), F.coalesce(number("confidence"), F.lit(0.0))).alias("confidence"), F.col("a.reasoning").alias("reasoning"),
    )


def parse_merge_pairs(responses: DataFrame) -> DataFrame:
    """Pairs of all answers; ``readable`` is false where the answer, the element, an id or the confidence can't be read."""
    rows = _items(responses, "merge_pairs").select("id", "place", as_object(F.col("item"), schemas.MERGE_PAIR).alias("p"))
    older, newer = as_id(F.col("p.older_id")), as_id(F.col("p.newer_id"))
    confidence = F.coalesce(F.col("p.confidence").try_cast("double"), F.when(F.col("p").isNotNull() & F.col("p.confidence").isNull(), F.lit(0.0)))
    return rows.select(
        "id", "place", older.alias("older_id"), newer.alias("newer_id"), confidence.alias("confidence"), F.coalesce("p.reason", F.lit("")).alias("reason"),
        (older.isNotNull() & newer.isNotNull() & confidence.isNotNull()).alias("readable"),
    )


def parse_recluster_diff(responses: DataFrame) -> DataFrame:
    """Proposals of all answers: (id, place, kind, payload, rationale).

    The payload is the element as it was written; a bare story id becomes an object.  What can't be
    read, an answer, a list or an element, is a row of kind ``error`` with its text as payload.
    """
    text = lambda field: lambda x: F.get_json_object(x, f"$.{field}")
    null = lambda x: F.lit(None).cast("string")
    kinds = [
        ("merge", "merge_candidates", False, text("reason")),
        ("split", "split_candidates", False, lambda x: F.concat(F.lit("split: "), F.coalesce(text("suggested_new_name")(x), F.lit("None")))),
        ("cool", "cooling_events", True, null),
        ("revive", "reviving_events", True, null),
        ("new", "new_events", False, text("name")),
    ]
    proposal = lambda place, kind, payload, rationale: F.struct(place.cast("int").alias("place"), kind.alias("kind"), payload.alias("payload"), rationale.alias("rationale"))
    lists = responses.select("id", "content", answer_lists(F.col("content"), [field for _, field, _, _ in kinds]).alias("d"))

    def tagged(kind: str, field: str, bare: bool, rationale) -> Column:
        def one(x: Column, i: Column) -> Column:
            payload = _json(as_id(x).alias("event_id")) if bare else x
            good = as_id(x).isNotNull() if bare else x.startswith("{") & parse_exact(x, T.VariantType()).isNotNull()
            bad = proposal(i, F.lit("error"), x, F.lit(f"unreadable element of {field}"))
            return F.when(F.coalesce(good, F.lit(False)), proposal(i, F.lit(kind), payload, rationale(x))).otherwise(bad)

        listed = F.col(f"d.{field}")
        lost = F.when(listed.isNotNull(), F.array(proposal(F.lit(None), F.lit("error"), listed, F.lit(f"unreadable {field}")))).otherwise(F.array())
        return F.coalesce(F.transform(elements(listed), one), lost)

    whole = F.array(proposal(F.lit(None), F.lit("error"), F.col("content"), F.lit("unreadable answer")))
    every = F.when(F.col("d").isNull(), whole).otherwise(F.concat(*[tagged(*kind) for kind in kinds]))
    return lists.select("id", F.explode(every).alias("p")).select("id", "p.place", "p.kind", "p.payload", "p.rationale")


def write_proposals(proposals: DataFrame, parsed: DataFrame, now) -> DataFrame:
    from storyloom.operators.ids import with_new_ids

    keyed = parsed.filter(F.col("kind") != "error").withColumn("_key", F.concat_ws(":", "id", "kind", "place")).drop("id", "place")
    fresh = with_new_ids(keyed, "_key", proposals).select("id", "kind", "payload", now_col(now).alias("created_at"), F.lit(0).alias("applied"), "rationale")
    return proposals.unionByName(fresh, allowMissingColumns=True)


def apply_proposals(stories: DataFrame, proposals: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Apply open ``cool`` and ``revive`` proposals in id order and mark them applied: (stories, proposals)."""
    from storyloom.operators.lifecycle import reset_expiry
    from storyloom.operators.updates import change_rows

    mine = (F.col("applied") == 0) & F.col("kind").isin("cool", "revive")
    event = F.get_json_object("payload", "$.event_id").try_cast("long")
    asked = proposals.filter(mine).select("id", event.alias("event_id"), "kind")
    revived = F.col("kind") == "revive"
    per_story = asked.groupBy(F.col("event_id").alias("id")).agg(F.max_by("kind", "id").alias("_last"), F.max(revived).alias("_revived"))
    current = stories.select("id", "archived_at", "expires_at").join(per_story, "id")
    changes = current.select(
        "id", F.when(F.col("_last") == "cool", "cooling").otherwise("active").alias("status"),
        F.when(~F.col("_revived"), F.col("archived_at")).alias("archived_at"),
        F.when(F.col("_revived"), reset_expiry(now)).otherwise(F.col("expires_at")).alias("expires_at"),
    )
    done = proposals.withColumns({
        "applied_at": F.when(mine, now_col(now)).otherwise(F.col("applied_at") if "applied_at" in proposals.columns else F.lit(None)),
        "applied": F.when(mine, F.lit(1)).otherwise(F.col("applied")),
    })
    return change_rows(stories, changes), done


def parse_summaries(responses: DataFrame) -> DataFrame:
    """Summary text of every answer, null where none can be read.

    Only answers that are not clean JSON pass through the Python recovery.
    """
    cleaned = responses.select("id", strip_code_fence(F.col("content")).alias("text"))
    judged = cleaned.withColumn("ok", parse_exact(F.col("text"), T.VariantType()).isNotNull())
    recovered = recover_summary(F.when(~F.col("ok"), F.col("text")))
    return judged.select("id", F.when(F.col("ok"), F.col("text")).otherwise(recovered).alias("summary_json"))
