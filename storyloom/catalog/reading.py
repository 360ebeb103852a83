"""Roll-ups, ranks and joined reads."""

from pyspark.sql import functions as F

from storyloom.catalog.registry import NOW, VISITOR, query
from storyloom.operators import rank, reads, rollups

# --- roll-ups ----------------------------------------------------------------


@query("story_article_counts", "SELECT event_id, count(*) AS article_count FROM articles WHERE event_id IS NOT NULL GROUP BY event_id")
def _(t):
    return rollups.story_article_counts(t.articles)


@query("story_feed_counts", "SELECT event_id, count(DISTINCT feed_source_id) AS feed_count FROM articles WHERE event_id IS NOT NULL AND feed_source_id IS NOT NULL GROUP BY event_id")
def _(t):
    return rollups.story_feed_counts(t.articles)


@query("story_importance_avg", "SELECT event_id, round(coalesce(avg(importance_score), 0), 6) AS importance_avg FROM articles WHERE event_id IS NOT NULL GROUP BY event_id")
def _(t):
    return rollups.story_importance_avg(t.articles)


@query("story_unread_counts", """
SELECT a.event_id, count(*) AS article_count, count(r.article_id) AS read_count, count(*) - count(r.article_id) AS unread_count
FROM articles a LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR}
WHERE a.event_id IS NOT NULL GROUP BY a.event_id""")
def _(t):
    return rollups.story_unread_counts(t.articles, t.article_reads, VISITOR)


@query("story_unread_all_visitors", """
WITH totals AS (SELECT event_id, count(*) AS n FROM articles WHERE event_id IS NOT NULL GROUP BY event_id)
SELECT r.visitor_id, a.event_id, count(*) AS read_count, any_value(t.n) - count(*) AS unread_count
FROM article_reads r JOIN articles a ON a.id = r.article_id JOIN totals t ON t.event_id = a.event_id GROUP BY r.visitor_id, a.event_id""")
def _(t):
    return rollups.story_unread_all_visitors(t.articles, t.article_reads)


@query("story_new_since_visit", """
SELECT a.event_id, count(*) FILTER (WHERE v.last_visited_at IS NULL OR a.fetched_at > v.last_visited_at) AS new_since_visit
FROM articles a LEFT JOIN event_visits v ON v.event_id = a.event_id AND v.visitor_id = {VISITOR}
WHERE a.event_id IS NOT NULL GROUP BY a.event_id""")
def _(t):
    return rollups.story_new_since_visit(t.articles, t.event_visits, VISITOR)


@query("inbox_counts", """
SELECT count(*) AS total, count(r.article_id) AS read, count(*) - count(r.article_id) AS unread
FROM articles a LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR} WHERE a.event_id IS NULL""")
def _(t):
    return rollups.inbox_counts(t.articles, t.article_reads, VISITOR)


@query("stats", """
SELECT (SELECT count(*) FROM articles) AS articles_total, (SELECT count(*) FROM articles WHERE event_id IS NULL) AS articles_ungrouped,
 (SELECT count(*) FROM stories WHERE status = 'active') AS events_active, (SELECT count(*) FROM stories WHERE status = 'cooling') AS events_cooling,
 (SELECT count(*) FROM stories WHERE status = 'archived') AS events_archived,
 (SELECT count(*) FROM stories WHERE status = 'archived' AND archived_at >= {NOW} - INTERVAL '24' HOUR) AS archived_recently,
 (SELECT count(*) FROM recluster_proposals WHERE applied = 0) AS proposals_pending, (SELECT count(*) FROM grouping_feedback) AS feedback_count""")
def _(t):
    return rollups.stats(t.articles, t.stories, t.recluster_proposals, t.grouping_feedback, NOW)


@query("feed_list", """
SELECT f.id, f.url, f.name, f.fetch_interval_minutes, f.last_fetched_at, f.is_paused,
 (SELECT count(*) FROM articles a WHERE a.feed_source_id = f.id) AS article_count, e.error AS last_error, e.last_attempted_at AS last_error_at,
 CASE WHEN f.is_paused THEN 'paused' WHEN e.url IS NOT NULL THEN 'error' ELSE 'ok' END AS label
FROM feed_sources f LEFT JOIN scrape_failures e ON e.url = f.url""")
def _(t):
    return rollups.feed_list(t.feed_sources, t.articles, t.scrape_failures)


@query("same_source_stories", """
SELECT s.id AS event_id, count(a.id) AS article_count FROM stories s JOIN articles a ON a.event_id = s.id
GROUP BY s.id HAVING count(a.id) <= 2 AND count(DISTINCT coalesce(a.publisher_name, '')) <= 1""")
def _(t):
    return rollups.same_source_stories(t.articles)


@query("distinct_source_check", """
SELECT event_id, count(DISTINCT coalesce(publisher_name, '<none>')) >= 2 AS distinct_sources FROM articles WHERE event_id IS NOT NULL GROUP BY event_id""")
def _(t):
    return rollups.distinct_source_check(rollups.grouped(t.articles), "event_id")


@query("publishers_per_story", """
SELECT event_id, publisher_name, count(*) AS article_count FROM articles WHERE event_id IS NOT NULL GROUP BY event_id, publisher_name""")
def _(t):
    return rollups.publishers_per_story(t.articles)


@query("min_articles", "SELECT event_id, count(*) AS article_count FROM articles WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) >= 5")
def _(t):
    return rollups.min_articles(rollups.story_article_counts(t.articles), 5)


# --- orders and top-k --------------------------------------------------------

_COUNTED = """
counted AS (SELECT s.id, s.status, s.created_at, s.last_article_at, count(a.id) AS article_count,
 least(ln(1.0e0 + count(a.id)) / ln(2.0e0), 6.0e0)
  * CASE WHEN s.last_article_at IS NULL THEN 0.5e0 ELSE pow(0.5e0, greatest(0.0e0, (epoch({NOW}) - epoch(s.last_article_at)) / 3600.0e0) / 8.0e0) END
  * (0.5e0 + 0.5e0 * greatest(0.0e0, least(1.0e0, coalesce(avg(a.importance_score), 0)))) AS score
 FROM stories s LEFT JOIN articles a ON a.event_id = s.id GROUP BY s.id, s.status, s.created_at, s.last_article_at)"""


def _counted(t):
    from storyloom.functions.scores import story_score

    rolled = rollups.grouped(t.articles).groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n"), F.avg("importance_score").alias("imp"))
    counted = t.stories.select("id", "status", "created_at", "last_article_at").join(rolled, "id", "left").withColumn("article_count", F.coalesce("n", F.lit(0)))
    score = story_score(F.col("article_count"), F.col("last_article_at"), F.col("imp"), rollups.now_col(NOW))
    return counted.withColumn("score", score).drop("n", "imp")


@query("story_score", f"WITH {_COUNTED} SELECT id, article_count, round(score, 6) AS score FROM counted")
def _(t):
    return _counted(t).select("id", "article_count", "score")


@query("rank_stories_normal", f"WITH {_COUNTED} SELECT id, article_count, last_article_at, created_at FROM counted", order="article_count DESC, last_article_at DESC NULLS LAST, created_at DESC NULLS LAST, id")
def _(t):
    return rank.rank_stories_normal(_counted(t).select("id", "article_count", "last_article_at", "created_at"))


@query("rank_stories_score", f"WITH {_COUNTED} SELECT id, article_count, last_article_at, round(score, 6) AS score, score AS exact_score FROM counted", order="exact_score DESC NULLS LAST, article_count DESC, last_article_at DESC NULLS LAST, id")
def _(t):
    return rank.rank_stories_score(_counted(t).select("id", "article_count", "last_article_at", "score")).withColumn("exact_score", F.col("score"))


@query("partition_top_minor", f"""
WITH {_COUNTED}, ordered AS (SELECT id, article_count, row_number() OVER (ORDER BY article_count DESC, last_article_at DESC NULLS LAST, id) AS rn, count(*) OVER () AS total FROM counted)
SELECT id, article_count, CASE WHEN rn <= CASE WHEN total <= 3 THEN total ELSE least(6, total - 1) END THEN 'top' ELSE 'minor' END AS section FROM ordered""")
def _(t):
    return rank.partition_top_minor(_counted(t), 6).select("id", "article_count", "section")


@query("latest_articles", """
SELECT a.id, a.title, a.event_id, a.published_date, a.fetched_at, r.article_id IS NOT NULL AS is_read FROM
 (SELECT * FROM articles ORDER BY published_date DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100) a LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR}""", order="published_date DESC NULLS LAST, id DESC")
def _(t):
    page = rank.latest_articles(t.articles, t.article_reads, VISITOR, offset=100, limit=50)
    return page.select("id", "title", "event_id", "published_date", "fetched_at", "is_read")


@query("latest_articles_ungrouped", """
SELECT a.id, a.title, a.published_date, r.article_id IS NOT NULL AS is_read FROM
 (SELECT * FROM articles WHERE event_id IS NULL ORDER BY published_date DESC NULLS LAST, id DESC LIMIT 50) a LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR}""", order="published_date DESC NULLS LAST, id DESC")
def _(t):
    return rank.latest_articles(t.articles, t.article_reads, VISITOR, ungrouped=True).select("id", "title", "published_date", "is_read")


@query("recent_titles", """
SELECT event_id, coalesce(string_agg(CASE WHEN title <> '' THEN title END, '|' ORDER BY rn), '') AS titles FROM
 (SELECT event_id, title, row_number() OVER (PARTITION BY event_id ORDER BY published_date DESC NULLS LAST, id DESC) AS rn FROM articles WHERE event_id IS NOT NULL) x
WHERE rn <= 5 GROUP BY event_id""")
def _(t):
    return rank.recent_titles(t.articles, 5).select("event_id", F.array_join("recent_titles", "|").alias("titles"))


@query("latest_summary", """
SELECT event_id, id, summary_json, generated_at, article_count FROM event_summaries
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY generated_at DESC, id DESC) = 1""")
def _(t):
    return rank.latest_summary(t.event_summaries)


@query("newest_article_per_story", """
SELECT event_id, id, published_date, fetched_at FROM articles WHERE event_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY published_date DESC NULLS LAST, fetched_at DESC NULLS LAST, id DESC) = 1""")
def _(t):
    return rank.newest_article_per_story(t.articles)


@query("few_shot", "SELECT id, article_id, kind, created_at FROM grouping_feedback ORDER BY created_at DESC, id DESC LIMIT 5")
def _(t):
    return rank.few_shot(t.grouping_feedback).select("id", "article_id", "kind", "created_at")


@query("chat_context", """
SELECT event_id, id, published_date, rn AS position, rn <= 5 AS is_source FROM
 (SELECT event_id, id, published_date, row_number() OVER (PARTITION BY event_id ORDER BY published_date DESC NULLS LAST, id DESC) AS rn FROM articles WHERE event_id IS NOT NULL) x WHERE rn <= 20""")
def _(t):
    return rank.chat_context(t.articles)


@query("chat_history", "SELECT event_id, visitor_id, created_at, id, role, content FROM event_chat_messages WHERE role IN ('user', 'assistant')", order="event_id, visitor_id, created_at, id")
def _(t):
    return rank.chat_history(t.event_chat_messages)


# --- joined reads ------------------------------------------------------------

_STORY_LIST = """
reaped AS (SELECT id, name, created_at, last_article_at, expires_at,
  CASE WHEN status = 'active' AND expires_at < {NOW} THEN 'archived' ELSE status END AS status,
  CASE WHEN status = 'active' AND expires_at < {NOW} THEN {NOW} ELSE archived_at END AS archived_at, status AS old_status FROM stories),
rolled AS (SELECT a.event_id, count(*) AS article_count, count(r.article_id) AS read_count, count(DISTINCT a.feed_source_id) AS feed_count,
  count(*) FILTER (WHERE v.last_visited_at IS NULL OR a.fetched_at > v.last_visited_at) AS new_since_visit, coalesce(avg(a.importance_score), 0) AS importance_avg
  FROM articles a LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR}
  LEFT JOIN event_visits v ON v.event_id = a.event_id AND v.visitor_id = {VISITOR} GROUP BY a.event_id)
SELECT s.id, s.name, s.status, s.created_at, s.last_article_at, s.archived_at, s.expires_at, r.article_count, r.read_count, r.feed_count, r.new_since_visit,
 round(r.importance_avg, 6) AS importance_avg, r.article_count - r.read_count AS unread_count"""
_SCORE = """round(least(ln(1.0e0 + r.article_count) / ln(2.0e0), 6.0e0)
  * CASE WHEN s.last_article_at IS NULL THEN 0.5e0 ELSE pow(0.5e0, greatest(0.0e0, (epoch({NOW}) - epoch(s.last_article_at)) / 3600.0e0) / 8.0e0) END
  * (0.5e0 + 0.5e0 * greatest(0.0e0, least(1.0e0, r.importance_avg))), 6)"""


@query("story_list", f"WITH {_STORY_LIST}, {_SCORE} AS score FROM reaped s JOIN rolled r ON r.event_id = s.id")
def story_list_by_score(t):
    return reads.story_list(t.stories, t.articles, t.article_reads, t.event_visits, VISITOR, NOW, sort="score")


@query("story_list_active", f"WITH {_STORY_LIST}, CAST(NULL AS DOUBLE) AS score FROM reaped s JOIN rolled r ON r.event_id = s.id WHERE s.status = 'active' AND s.old_status = 'active' AND r.article_count >= 2")
def _(t):
    return reads.story_list(t.stories, t.articles, t.article_reads, t.event_visits, VISITOR, NOW, status="active", min_articles=2)


@query("story_list_archived", f"WITH {_STORY_LIST}, CAST(NULL AS DOUBLE) AS score FROM reaped s JOIN rolled r ON r.event_id = s.id WHERE s.old_status = 'archived'")
def _(t):
    return reads.story_list(t.stories, t.articles, t.article_reads, t.event_visits, VISITOR, NOW, status="archived")


@query("story_details", """
WITH newest AS (SELECT event_id, id, generated_at FROM event_summaries QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY generated_at DESC, id DESC) = 1)
SELECT s.id AS event_id, s.name, CASE WHEN s.status = 'active' AND s.expires_at < {NOW} THEN 'archived' ELSE s.status END AS status, s.last_article_at,
 CAST(NULL AS VARCHAR) AS description, CAST(NULL AS INTEGER) AS summary_version,
 n.id AS summary_id, n.generated_at AS summary_at, a.id AS article_id, a.title, a.url, a.publisher_name, round(a.importance_score, 6) AS importance_score, a.published_date, a.word_count,
 CASE WHEN a.id IS NOT NULL THEN r.article_id IS NOT NULL END AS is_read
FROM stories s LEFT JOIN newest n ON n.event_id = s.id LEFT JOIN articles a ON a.event_id = s.id
LEFT JOIN article_reads r ON r.article_id = a.id AND r.visitor_id = {VISITOR}""")
def _(t):
    return reads.story_details(t.stories, t.articles, t.article_reads, t.event_summaries, VISITOR, NOW)


@query("story_summaries", """
SELECT event_id, id AS summary_id, generated_at, article_count, summary_json FROM event_summaries WHERE event_id IN (SELECT id FROM stories)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY generated_at DESC, id DESC) = 1""")
def _(t):
    return reads.story_summaries(t.stories, t.event_summaries)


@query("search_articles", """
SELECT h.id, h.title, h.published_date, h.event_id, s.name AS event_name, r.article_id IS NOT NULL AS is_read FROM
 (SELECT * FROM articles WHERE title ILIKE '%the%' OR rss_description ILIKE '%the%' ORDER BY published_date DESC NULLS LAST, id DESC LIMIT 20) h
LEFT JOIN stories s ON s.id = h.event_id LEFT JOIN article_reads r ON r.article_id = h.id AND r.visitor_id = {VISITOR}""")
def _(t):
    hits = reads.search_articles(t.articles, t.stories, t.article_reads, "the", VISITOR)
    return hits.select("id", "title", "published_date", "event_id", "event_name", "is_read")


_EXAMPLES = """
examples AS (SELECT f.id, f.created_at, f.article_id, f.kind, f.original_event_id, f.corrected_event_id, o.name AS original_event_name, c.name AS corrected_event_name, f.note
 FROM (SELECT * FROM grouping_feedback ORDER BY created_at DESC, id DESC LIMIT 5) f LEFT JOIN stories o ON o.id = f.original_event_id LEFT JOIN stories c ON c.id = f.corrected_event_id)"""


@query("few_shot_examples", f"WITH {_EXAMPLES} SELECT * FROM examples")
def _(t):
    return reads.few_shot_examples(t.grouping_feedback, t.stories)


@query("few_shot_block", f"""
WITH {_EXAMPLES} SELECT 'Recent editor corrections (treat as ground truth):' || chr(10) || string_agg('  - [' || kind || '] article_id=' || CAST(article_id AS VARCHAR)
 || ': from ''' || coalesce(original_event_name, '(none)') || ''' to ''' || coalesce(corrected_event_name, '(none)') || '''' || CASE WHEN note <> '' THEN ' — ' || note ELSE '' END, chr(10) ORDER BY created_at DESC, id DESC) AS block FROM examples""")
def _(t):
    return reads.few_shot_block(reads.few_shot_examples(t.grouping_feedback, t.stories))


@query("empty_stories", """
SELECT s.id, s.created_at FROM stories s WHERE s.created_at < {NOW} - INTERVAL '30' SECOND AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.event_id = s.id)""")
def _(t):
    return reads.empty_stories(t.stories, t.articles, NOW).select("id", "created_at")


@query("summary_stale", """
SELECT s.id, s.last_article_at, max(e.generated_at) AS generated_at, coalesce(s.last_article_at > max(e.generated_at), false) AS stale
FROM stories s LEFT JOIN event_summaries e ON e.event_id = s.id GROUP BY s.id, s.last_article_at""")
def _(t):
    return reads.summary_stale(t.stories, t.event_summaries)


@query("pending_suggestions", """
SELECT proposed_event_name, count(*) AS article_count, max(published_date) AS newest FROM articles WHERE event_id IS NULL AND proposed_event_name IS NOT NULL GROUP BY proposed_event_name""")
def _(t):
    return reads.pending_suggestions(t.articles)


@query("importance_bucket", """
SELECT id, CASE WHEN coalesce(importance_score, 0) >= 0.7e0 THEN 'lg' WHEN coalesce(importance_score, 0) < 0.3e0 THEN 'sm' ELSE 'md' END AS bucket, coalesce(grouping_confidence, 0) < 0.5e0 AS uncertain FROM articles""")
def _(t):
    return reads.story_display(t.articles)
