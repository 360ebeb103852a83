"""Grouping, model answers, payloads and proposals."""

from pyspark.sql import functions as F

from storyloom.catalog.changing import _new_ids
from storyloom.catalog.ingesting import article_type, title_type
from storyloom.catalog.registry import NOW, query
from storyloom.operators import grouping, payloads, proposing, rollups

_EXPIRY = "{NOW} + INTERVAL '48' HOUR"
_NEWEST = "published_date DESC NULLS LAST, id DESC"


def _norm(expr: str) -> str:
    return rf"lower(trim(regexp_replace({expr}, '\s+', ' ', 'g')))"


_JUDGED = """
judged AS (SELECT d.pos, d.article_id, d.decision, CASE WHEN d.decision = 'existing' THEN d.event_id END AS event_id, nullif(trim(d.event_name), '') AS story_name,
 CASE WHEN d.importance_score IS NULL OR d.importance_score = 0 THEN 0.5e0 ELSE d.importance_score END AS importance, coalesce(d.confidence, 0) AS confidence,
 a.id IS NOT NULL AS known, s.id IS NOT NULL AS story_known, a.published_date AS pub, a.publisher_name, a.event_id AS old_event, a.importance_score AS old_importance
 FROM decisions d LEFT JOIN articles a ON a.id = d.article_id LEFT JOIN stories s ON s.id = d.event_id),
checked AS (SELECT *, CASE WHEN NOT known THEN 'errors' WHEN decision = 'existing' AND NOT story_known THEN 'errors' WHEN decision = 'new' AND story_name IS NULL THEN 'errors'
 WHEN decision IN ('existing', 'new', 'uncategorized') THEN decision ELSE 'errors' END AS plain FROM judged)"""

_HOMES = """
oldest AS (SELECT """ + _norm("name") + """ AS norm, id, status FROM stories WHERE status = 'active' OR (status = 'archived' AND archived_at >= {NOW} - INTERVAL '30' DAY)
 QUALIFY row_number() OVER (PARTITION BY """ + _norm("name") + """ ORDER BY created_at, id) = 1),
fresh_names AS (SELECT n.norm, """ + _new_ids("stories", "n.norm") + """ AS id FROM names n WHERE n.norm NOT IN (SELECT norm FROM oldest)),
homes AS (SELECT n.norm, n.story_name, n.first_pos, o.id AS home, CASE WHEN o.status = 'archived' THEN 'revived' ELSE 'reused' END AS how FROM names n JOIN oldest o ON o.norm = n.norm
 UNION ALL SELECT n.norm, n.story_name, n.first_pos, f.id, 'created' FROM names n JOIN fresh_names f ON f.norm = n.norm)"""

_ARTICLES_OUT = """
SELECT a.id, CASE WHEN l.effect = 'attach' THEN l.target ELSE a.event_id END AS event_id,
 CASE WHEN l.effect IS NULL THEN a.proposed_event_name WHEN l.effect = 'suggest' THEN l.story_name END AS proposed_event_name,
 round(CASE WHEN l.effect IS NULL OR l.effect = 'uncategorize' THEN a.importance_score ELSE l.importance END, 6) AS importance_score,
 round(CASE WHEN l.effect IS NULL THEN a.grouping_confidence ELSE l.confidence END, 6) AS grouping_confidence, CASE WHEN l.effect IS NOT NULL THEN {NOW} END AS grouped_at
FROM articles a LEFT JOIN last l ON l.article_id = a.id"""
_A = ["id", "event_id", "proposed_event_name", "importance_score", "grouping_confidence", "grouped_at"]
_ST = ["id", "name", "status", "last_article_at", "archived_at", "expires_at"]

_LIVE = f"""{_JUDGED},
effects AS (SELECT *, CASE plain WHEN 'new' THEN 'singleton' ELSE plain END AS outcome, event_id AS target, CASE plain WHEN 'existing' THEN 'attach' WHEN 'new' THEN 'suggest' WHEN 'uncategorized' THEN 'uncategorize' END AS effect FROM checked),
last AS (SELECT * FROM effects WHERE effect IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos DESC) = 1)"""


def _live(t):
    return grouping.apply_live(t.articles, t.stories, t.decisions, NOW)


@query("apply_live_articles", f"WITH {_LIVE} {_ARTICLES_OUT}")
def _(t):
    return _live(t).articles.select(*_A)


_TOUCHED = """touched AS (SELECT target, max(pub) AS newest, arg_min(coalesce(pub, {NOW}), pos) AS first_date FROM effects WHERE effect = 'attach' GROUP BY target)"""


@query("apply_live_stories", f"""WITH {_LIVE}, {_TOUCHED}
SELECT s.id, s.name, CASE WHEN t.target IS NULL THEN s.status ELSE 'active' END AS status, CASE WHEN t.target IS NULL THEN s.last_article_at ELSE greatest(coalesce(s.last_article_at, t.first_date), t.newest) END AS last_article_at,
 CASE WHEN t.target IS NULL THEN s.archived_at END AS archived_at, CASE WHEN t.target IS NULL THEN s.expires_at ELSE {_EXPIRY} END AS expires_at FROM stories s LEFT JOIN touched t ON t.target = s.id""")
def _(t):
    return _live(t).stories.select(*_ST)


@query("assign_counts", f"WITH {_LIVE} SELECT outcome, count(*) AS n FROM effects GROUP BY outcome")
def _(t):
    return rollups.outcome_counts(_live(t).log)


@query("summary_targets_live", f"WITH {_LIVE} SELECT DISTINCT target AS event_id, article_id, 'incremental' AS kind FROM effects WHERE effect = 'attach'")
def _(t):
    return grouping.summary_targets(_live(t))


_OPEN = f"""{_JUDGED},
named AS (SELECT *, {_norm('story_name')} AS norm FROM checked WHERE plain = 'new'),
names AS (SELECT norm, arg_min(story_name, pos) AS story_name, min(pos) AS first_pos FROM named GROUP BY norm), {_HOMES},
effects AS (SELECT c.*, coalesce(h.home, c.event_id) AS target, CASE WHEN h.home IS NULL THEN c.plain WHEN c.pos = h.first_pos AND h.how = 'created' THEN 'new' WHEN c.pos = h.first_pos AND h.how = 'revived' THEN 'revived' ELSE 'reused' END AS outcome,
 CASE c.plain WHEN 'uncategorized' THEN 'uncategorize' WHEN 'errors' THEN NULL ELSE 'attach' END AS effect FROM checked c LEFT JOIN homes h ON c.plain = 'new' AND h.norm = {_norm('c.story_name')}),
last AS (SELECT * FROM effects WHERE effect IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos DESC) = 1)"""


def _open(t):
    return grouping.apply_live(t.articles, t.stories, t.decisions, NOW, require_distinct=False)


@query("apply_live_open_articles", f"WITH {_OPEN} {_ARTICLES_OUT}")
def _(t):
    return _open(t).articles.select(*_A)


@query("apply_live_open_stories", f"""WITH {_OPEN},
touched AS (SELECT target, max(pub) AS newest, arg_min(coalesce(pub, {{NOW}}), pos) AS first_date, max(CASE WHEN plain = 'new' THEN coalesce(pub, {{NOW}}) END) AS anchor FROM effects WHERE effect = 'attach' GROUP BY target),
every AS (SELECT id, name, status, last_article_at, archived_at, expires_at FROM stories UNION ALL SELECT home, story_name, 'active', NULL, NULL, {_EXPIRY} FROM homes WHERE how = 'created')
SELECT s.id, s.name, CASE WHEN t.target IS NULL THEN s.status ELSE 'active' END AS status, CASE WHEN t.target IS NULL THEN s.last_article_at ELSE greatest(coalesce(s.last_article_at, t.first_date), t.newest, t.anchor) END AS last_article_at,
 CASE WHEN t.target IS NULL THEN s.archived_at END AS archived_at, CASE WHEN t.target IS NULL THEN s.expires_at ELSE {_EXPIRY} END AS expires_at FROM every s LEFT JOIN touched t ON t.target = s.id""")
def _(t):
    return _open(t).stories.select(*_ST)


@query("apply_live_open_log", f"WITH {_OPEN} SELECT pos, outcome FROM effects")
def _(t):
    return _open(t).log


@query("find_or_create", f"""WITH {_JUDGED}, named AS (SELECT *, {_norm('story_name')} AS norm FROM judged WHERE story_name IS NOT NULL),
names AS (SELECT norm, arg_min(story_name, pos) AS story_name, min(pos) AS first_pos FROM named GROUP BY norm), {_HOMES} SELECT norm, story_name, home AS id, how AS outcome FROM homes""")
def _(t):
    from storyloom.functions.text import non_empty, normalize_event_name, strip

    names = t.decisions.select("pos", non_empty(strip(F.col("event_name"))).alias("story_name")).filter(F.col("story_name").isNotNull())
    firsts = names.groupBy(normalize_event_name(F.col("story_name")).alias("norm")).agg(F.min_by("story_name", "pos").alias("story_name"))
    return grouping.find_or_create(firsts, t.stories, NOW)


_REGROUP = f"""{_JUDGED},
members AS (SELECT *, {_norm('story_name')} AS norm FROM checked WHERE decision = 'new' AND story_name IS NOT NULL),
sizes AS (SELECT story_name, any_value(norm) AS norm, count(*) AS size, min(pos) AS first_pos, arg_min(known, pos) AS first_known, arg_min(coalesce(pub, {{NOW}}), pos) AS anchor,
 count(DISTINCT CASE WHEN known THEN coalesce(publisher_name, '<none>') END) AS sources FROM members GROUP BY story_name),
clusters AS (SELECT *, CASE WHEN size < 2 THEN 'new_singletons' WHEN NOT first_known THEN 'errors' WHEN sources < 2 THEN 'new_singletons' ELSE 'founding' END AS verdict FROM sizes),
names AS (SELECT norm, arg_min(story_name, first_pos) AS story_name, min(first_pos) AS first_pos FROM clusters WHERE verdict = 'founding' GROUP BY norm), {_HOMES},
settled AS (SELECT c.story_name, c.first_pos, c.anchor, CASE WHEN c.verdict = 'founding' THEN h.home END AS home, CASE WHEN c.verdict <> 'founding' THEN c.verdict WHEN c.first_pos = h.first_pos AND h.how = 'created' THEN 'new_events'
 WHEN c.first_pos = h.first_pos AND h.how = 'revived' THEN 'revived' ELSE 'reused' END AS verdict FROM clusters c LEFT JOIN homes h ON h.norm = c.norm),
effects AS (SELECT pos, article_id, pub, story_name, importance, confidence, event_id AS target, CASE plain WHEN 'existing' THEN 'attach' ELSE 'uncategorize' END AS effect, 0 AS phase, 0 AS cluster_pos FROM checked WHERE plain IN ('existing', 'uncategorized')
 UNION ALL SELECT m.pos, m.article_id, m.pub, m.story_name, m.importance, m.confidence, s.home, CASE s.verdict WHEN 'new_singletons' THEN 'suggest' ELSE 'attach' END, 1, s.first_pos FROM members m JOIN settled s ON s.story_name = m.story_name WHERE m.known AND s.verdict <> 'errors'),
last AS (SELECT * FROM effects QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY phase DESC, cluster_pos DESC, pos DESC) = 1)"""


def _regroup(t):
    return grouping.apply_regroup(t.articles, t.stories, t.decisions, NOW)


@query("apply_regroup_articles", f"WITH {_REGROUP} {_ARTICLES_OUT}")
def _(t):
    return _regroup(t).articles.select(*_A)


@query("apply_regroup_stories", f"""WITH {_REGROUP},
touched AS (SELECT target, max(pub) AS newest, arg_min(coalesce(pub, {{NOW}}), pos) FILTER (WHERE phase = 0) AS first_date FROM effects WHERE effect = 'attach' GROUP BY target),
anchors AS (SELECT home, max(anchor) AS anchor FROM settled WHERE home IS NOT NULL GROUP BY home),
every AS (SELECT id, name, status, last_article_at, archived_at, expires_at FROM stories UNION ALL SELECT home, story_name, 'active', NULL, NULL, {_EXPIRY} FROM homes WHERE how = 'created')
SELECT s.id, s.name, CASE WHEN t.target IS NULL THEN s.status ELSE 'active' END AS status,
 CASE WHEN t.target IS NULL THEN s.last_article_at ELSE greatest(s.last_article_at, CASE WHEN s.last_article_at IS NULL THEN t.first_date END, t.newest, a.anchor) END AS last_article_at,
 CASE WHEN t.target IS NULL THEN s.archived_at END AS archived_at, CASE WHEN t.target IS NULL THEN s.expires_at ELSE {_EXPIRY} END AS expires_at
FROM every s LEFT JOIN touched t ON t.target = s.id LEFT JOIN anchors a ON a.home = s.id""")
def _(t):
    return _regroup(t).stories.select(*_ST)


@query("regroup_counts", f"WITH {_REGROUP} SELECT outcome, count(*) AS n FROM (SELECT plain AS outcome FROM checked WHERE plain <> 'new' UNION ALL SELECT verdict FROM settled) x GROUP BY outcome")
def _(t):
    return rollups.outcome_counts(_regroup(t).log)


@query("summary_targets", f"WITH {_REGROUP} SELECT DISTINCT e.target AS event_id, e.article_id, CASE WHEN h.how = 'created' THEN 'initial' ELSE 'incremental' END AS kind FROM effects e LEFT JOIN homes h ON h.home = e.target WHERE e.effect = 'attach'")
def _(t):
    return grouping.summary_targets(_regroup(t))


@query("ungrouped", "SELECT id, published_date FROM articles WHERE event_id IS NULL", order=_NEWEST)
def _(t):
    return grouping.ungrouped(t.articles).select("id", "published_date")


@query("ungrouped_batch", f"SELECT id, published_date FROM articles WHERE event_id IS NULL ORDER BY {_NEWEST} LIMIT 100", order=_NEWEST)
def _(t):
    return grouping.ungrouped(t.articles, limit=100).select("id", "published_date")


@query("assignable_stories", "SELECT id, status, last_article_at FROM stories WHERE status IN ('active', 'cooling')", order="last_article_at DESC NULLS LAST, id")
def _(t):
    return grouping.assignable_stories(t.stories).select("id", "status", "last_article_at")


# --- payloads ----------------------------------------------------------------

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_TITLES = f"""titles AS (SELECT event_id, to_json(list(title ORDER BY rn) FILTER (WHERE title <> '')) AS recent FROM (SELECT event_id, title, row_number() OVER (PARTITION BY event_id ORDER BY {_NEWEST}) AS rn FROM articles WHERE event_id IS NOT NULL) x WHERE rn <= 5 GROUP BY event_id)"""


def _text(expr: str) -> str:
    return f"coalesce(CAST(to_json({expr}) AS VARCHAR), 'null')"


_STORY_LINE = "'{\"id\":' || CAST(s.id AS VARCHAR) || ',\"name\":' || " + _text("s.name") + " || ',\"description\":null,\"last_article_at\":' || " + _text(_ISO.format("s.last_article_at")) + " || ',\"recent_titles\":' || coalesce(nullif(CAST(t.recent AS VARCHAR), 'null'), '[]') || '}'"
_STORY_LINES = f"SELECT s.status AS section, s.id, {_STORY_LINE} AS line FROM stories s LEFT JOIN titles t ON t.event_id = s.id"


def _article_lines(chars: int, typed: bool) -> str:
    hint = " || ',\"content_type\":' || " + _text(title_type("a.title")) if typed else ""
    snippet = f"left(coalesce(nullif(a.scraped_text_content, ''), nullif(a.rss_description, ''), ''), {chars})"
    fields = [("title", "a.title"), ("source", "a.publisher_name"), ("published_date", _ISO.format("a.published_date")), ("snippet", snippet)]
    body = "".join(f" || ',\"{name}\":' || {_text(expr)}" for name, expr in fields)
    return f"SELECT 'article' AS section, a.id, '{{\"id\":' || CAST(a.id AS VARCHAR){body}{hint} || '}}' AS line FROM articles a"


_WINDOW = f"""win AS (SELECT status AS section, id FROM stories WHERE status IN ('active', 'cooling') OR (status = 'archived' AND archived_at >= {{NOW}} - INTERVAL '30' DAY)
 UNION ALL SELECT 'unassigned', id FROM (SELECT id FROM articles WHERE event_id IS NULL AND published_date >= {{NOW}} - INTERVAL '14' DAY) u)"""


@query("group_payload", f"WITH {_TITLES} {_STORY_LINES} WHERE s.status IN ('active', 'cooling') UNION ALL {_article_lines(500, True)} WHERE a.event_id IS NULL")
def _(t):
    return payloads.group_payload(t.articles, t.stories)


@query("recluster_window", f"WITH {_WINDOW} SELECT section, id FROM win")
def _(t):
    return payloads.recluster_window(t.articles, t.stories, NOW)


@query("recluster_payload", f"""WITH {_TITLES}, {_WINDOW} {_STORY_LINES} WHERE s.id IN (SELECT id FROM win WHERE section <> 'unassigned')
 UNION ALL {_article_lines(300, False)} WHERE a.id IN (SELECT id FROM win WHERE section = 'unassigned')""")
def _(t):
    return payloads.recluster_payload(t.articles, t.stories, NOW)


@query("mark_seen_in_recluster", "SELECT id, CASE WHEN status IN ('active', 'cooling') THEN {NOW} END AS last_seen_in_recluster_at FROM stories")
def _(t):
    from storyloom.operators.lifecycle import mark_seen_in_recluster

    return mark_seen_in_recluster(t.stories, NOW).select("id", "last_seen_in_recluster_at")


_BLOCK = """'--- Article ---' || chr(10) || 'Title: ' || coalesce(title, 'None') || chr(10) || 'Source: ' || coalesce(publisher_name, 'None') || ' (' || coalesce(""" + _ISO.format("published_date") + """, 'None') || ')' || chr(10)
 || 'URL: ' || coalesce(url, 'None') || chr(10) || 'Content: ' || coalesce(nullif(scraped_text_content, ''), nullif(rss_description, ''), 'No content available.') || chr(10)"""
_PER_URL = f"QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY {_NEWEST}) = 1"


@query("summary_payload", f"SELECT event_id, published_date, id, {_BLOCK} AS block FROM articles WHERE event_id IS NOT NULL {_PER_URL}", order=f"event_id, {_NEWEST}")
def _(t):
    return payloads.summary_payload(t.articles)


_PRIOR = "prior AS (SELECT event_id, id AS prior_id FROM (SELECT * FROM event_summaries QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY generated_at DESC, id DESC) = 1) x WHERE summary_json IS NOT NULL)"


@query("incremental_payload", f"""WITH {_LIVE}, {_PRIOR}, targets AS (SELECT DISTINCT target AS event_id, article_id FROM effects WHERE effect = 'attach'),
placed AS (SELECT a.* REPLACE (CASE WHEN l.effect = 'attach' THEN l.target ELSE a.event_id END AS event_id) FROM articles a LEFT JOIN last l ON l.article_id = a.id),
chosen AS (SELECT p.*, r.prior_id FROM placed p JOIN (SELECT DISTINCT event_id FROM targets) g ON g.event_id = p.event_id LEFT JOIN prior r ON r.event_id = p.event_id LEFT JOIN targets n ON n.event_id = p.event_id AND n.article_id = p.id
 WHERE r.prior_id IS NULL OR n.article_id IS NOT NULL)
SELECT event_id, prior_id, published_date, id, {_BLOCK} AS block FROM chosen {_PER_URL}""")
def _(t):
    live = _live(t)
    return payloads.incremental_payload(live.articles, t.event_summaries, grouping.summary_targets(live))


_CHAT_BLOCK = r"""'--- ' || coalesce(nullif(title, ''), 'Untitled') || ' (' || coalesce(nullif(publisher_name, ''), 'Unknown Source') || ', ' || coalesce(""" + _ISO.format("published_date") + r""", 'Unknown Date') || ') ---' || chr(10)
 || coalesce(CASE WHEN length(content) > 3000 THEN regexp_replace(left(content, 3000), '\s+$', '') || '...' ELSE content END, 'No content available.') || chr(10)"""
_CHAT = f"""picked AS (SELECT *, coalesce(nullif(scraped_text_content, ''), nullif(rss_description, '')) AS content, row_number() OVER (PARTITION BY event_id ORDER BY {_NEWEST}) AS position FROM articles WHERE event_id IS NOT NULL),
blocks AS (SELECT event_id, position, id, position <= 5 AS is_source, {_CHAT_BLOCK} AS block FROM picked WHERE position <= 20 QUALIFY row_number() OVER (PARTITION BY event_id, url ORDER BY position) = 1)"""


@query("chat_blocks", f"WITH {_CHAT} SELECT event_id, position, id, is_source, block FROM blocks")
def _(t):
    return payloads.chat_blocks(t.articles)


_SUMMARY_BLOCK = """
newest AS (SELECT event_id, summary_json AS j FROM event_summaries QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY generated_at DESC, id DESC) = 1),
flat AS (SELECT event_id, CASE WHEN j IS NULL OR j = '{}' THEN '(no summary has been generated for this event yet)' ELSE concat_ws(chr(10),
 'Key developments:' || chr(10) || array_to_string(['- ' || x for x in CAST(json_extract(j, '$.key_developments') AS VARCHAR[])[1:5]], chr(10)),
 'Progressive update: ' || nullif(trim(json_extract_string(j, '$.progressive_summary')), ''),
 'Timeline:' || chr(10) || array_to_string(['  - ' || coalesce(json_extract_string(x, '$.date'), '') || ': ' || json_extract_string(x, '$.text') for x in CAST(json_extract(j, '$.timeline_narrative') AS JSON[]) if coalesce(json_extract_string(x, '$.text'), '') <> ''], chr(10)),
 'Cross-source synthesis: ' || nullif(trim(json_extract_string(j, '$.cross_source_synthesis.synthesis')), ''),
 'By source:' || chr(10) || array_to_string(['  - ' || coalesce(json_extract_string(x, '$.source'), 'Unknown') || ': ' || json_extract_string(x, '$.observation') for x in CAST(json_extract(j, '$.cross_source_synthesis.by_source') AS JSON[]) if coalesce(json_extract_string(x, '$.observation'), '') <> ''], chr(10))
 ) END AS summary_block FROM newest)"""


@query("summary_block", f"WITH {_SUMMARY_BLOCK} SELECT event_id, summary_block FROM flat")
def _(t):
    return payloads.summary_blocks(t.event_summaries)


@query("chat_payload", f"""WITH {_CHAT}, {_SUMMARY_BLOCK}
SELECT s.id AS event_id, s.name, string_agg(b.block, chr(10) ORDER BY b.position) AS articles_block, coalesce(any_value(f.summary_block), '(no summary has been generated for this event yet)') AS summary_block
FROM stories s JOIN blocks b ON b.event_id = s.id LEFT JOIN flat f ON f.event_id = s.id GROUP BY s.id, s.name""")
def _(t):
    return payloads.chat_payload(t.stories, t.articles, t.event_summaries)


@query("source_observations", """
SELECT e.id, e.event_id, i - 1 AS place, coalesce(nullif(json_extract_string(x, '$.source'), ''), 'Unknown') AS source, json_extract_string(x, '$.observation') AS observation
FROM (SELECT id, event_id, unnest(CAST(json_extract(summary_json, '$.cross_source_synthesis.by_source') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(summary_json, '$.cross_source_synthesis.by_source') AS JSON[]), 1) AS i FROM event_summaries WHERE summary_json IS NOT NULL) e""")
def _(t):
    return payloads.source_observations(t.event_summaries)


_ANSWERS = "answers AS (SELECT s.id AS event_id, '{\"progressive_summary\":\"fresh ' || CAST(s.id AS VARCHAR) || '\"}' AS summary_json FROM stories s WHERE s.status = 'active')"


def _fresh_answers(t):
    return t.stories.filter(F.col("status") == "active").select(
        F.col("id").alias("event_id"), F.concat(F.lit('{"progressive_summary":"fresh '), F.col("id").cast("string"), F.lit('"}')).alias("summary_json")
    )


def _saved(t, regenerated=False):
    return payloads.save_summary(t.event_summaries, t.stories, t.articles, _fresh_answers(t), NOW, regenerated, model="m1")


@query("save_summary_summaries", f"""WITH {_ANSWERS} SELECT id, event_id, summary_json, article_count, NULL AS model_used FROM event_summaries
UNION ALL SELECT {_new_ids('event_summaries', 'n.event_id')}, n.event_id, n.summary_json, (SELECT count(DISTINCT a.url) FROM articles a WHERE a.event_id = n.event_id), 'm1' FROM answers n""")
def _(t):
    return _saved(t)[0].select("id", "event_id", "summary_json", "article_count", "model_used")


@query("summary_lineage", f"""WITH {_ANSWERS}, fresh AS (SELECT {_new_ids('event_summaries', 'n.event_id')} AS summary_id, n.event_id FROM answers n)
SELECT f.summary_id, f.event_id, a.id AS article_id FROM fresh f JOIN (SELECT * FROM articles WHERE event_id IS NOT NULL {_PER_URL}) a ON a.event_id = f.event_id""")
def _(t):
    return payloads.summary_lineage(_saved(t)[0], _fresh_answers(t), payloads.summarised_articles(t.articles))


@query("save_summary_stories", f"""WITH {_ANSWERS} SELECT s.id, CASE WHEN n.event_id IS NOT NULL THEN {{NOW}} END AS last_summary_at, CASE WHEN n.event_id IS NOT NULL THEN (SELECT count(DISTINCT a.url) FROM articles a WHERE a.event_id = s.id) END AS summary_article_count,
 CASE WHEN n.event_id IS NOT NULL THEN 1 END AS summary_version FROM stories s LEFT JOIN answers n ON n.event_id = s.id""")
def _(t):
    return _saved(t)[1].select("id", "last_summary_at", "summary_article_count", "summary_version")


@query("regenerated_summaries", f"""WITH {_ANSWERS} SELECT n.event_id, CASE WHEN n.event_id IN (SELECT event_id FROM event_summaries WHERE summary_json IS NOT NULL) THEN '(Updates based on new articles) ' ELSE '' END || 'fresh ' || CAST(n.event_id AS VARCHAR) AS progressive FROM answers n""")
def _(t):
    fresh = _saved(t, regenerated=True)[0].join(t.event_summaries.select("id"), "id", "left_anti")
    return fresh.select("event_id", F.get_json_object("summary_json", "$.progressive_summary").alias("progressive"))


# --- answers -----------------------------------------------------------------


def _fenced(expr: str) -> str:
    strip = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"
    opened = f"regexp_replace(regexp_replace({strip(expr)}, '^```json', ''), '^```', '')"
    return strip(f"regexp_replace({opened}, '```$', '')")


_CLEAN = f"clean AS (SELECT id, CASE WHEN json_valid({_fenced('content')}) THEN {_fenced('content')} END AS j FROM {{}})"


@query("parse_assignments", f"""WITH {_CLEAN.format('assignment_responses')},
items AS (SELECT id, unnest(CAST(json_extract(j, '$.assignments') AS JSON[])) AS a, generate_subscripts(CAST(json_extract(j, '$.assignments') AS JSON[]), 1) - 1 AS place FROM clean WHERE j IS NOT NULL)
SELECT id, place, false AS error, CAST(CAST(json_extract_string(a, '$.article_id') AS DOUBLE) AS BIGINT) AS article_id, json_extract_string(a, '$.decision') AS decision, CAST(json_extract_string(a, '$.event_id') AS BIGINT) AS event_id,
 json_extract_string(a, '$.event_name') AS event_name, coalesce(nullif(CAST(json_extract_string(a, '$.importance_score') AS DOUBLE), 0), 0.5) AS importance_score, coalesce(CAST(json_extract_string(a, '$.confidence') AS DOUBLE), 0) AS confidence,
 json_extract_string(a, '$.reasoning') AS reasoning FROM items WHERE json_type(a) = 'OBJECT'
UNION ALL SELECT id, place, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM items WHERE json_type(a) <> 'OBJECT'
UNION ALL SELECT id, NULL, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM clean WHERE j IS NULL""")
def _(t):
    return payloads.parse_assignments(t.assignment_responses)


@query("parse_merge_pairs", f"""WITH {_CLEAN.format('merge_responses')},
items AS (SELECT id, json_extract(j, '$.merge_pairs[0]') AS p FROM clean WHERE j IS NOT NULL),
typed AS (SELECT id, try_cast(json_extract_string(p, '$.older_id') AS BIGINT) AS older_id, try_cast(json_extract_string(p, '$.newer_id') AS BIGINT) AS newer_id,
 coalesce(try_cast(json_extract_string(p, '$.confidence') AS DOUBLE), CASE WHEN json_extract_string(p, '$.confidence') IS NULL THEN 0 END) AS confidence, json_extract_string(p, '$.reason') AS reason FROM items)
SELECT id, 0 AS place, older_id, newer_id, confidence, reason, older_id IS NOT NULL AND newer_id IS NOT NULL AND confidence IS NOT NULL AS readable FROM typed
UNION ALL SELECT id, NULL, NULL, NULL, NULL, '', false FROM clean WHERE j IS NULL""")
def _(t):
    return payloads.parse_merge_pairs(t.merge_responses)


_DIFF = f"""{_CLEAN.format('recluster_responses')},
exploded AS (SELECT id, kind, CAST(x AS VARCHAR) AS x, place FROM (
 SELECT id, 'merge' AS kind, unnest(CAST(json_extract(j, '$.merge_candidates') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(j, '$.merge_candidates') AS JSON[]), 1) - 1 AS place FROM clean
 UNION ALL SELECT id, 'split', unnest(CAST(json_extract(j, '$.split_candidates') AS JSON[])), generate_subscripts(CAST(json_extract(j, '$.split_candidates') AS JSON[]), 1) - 1 FROM clean
 UNION ALL SELECT id, 'cool', unnest(CAST(json_extract(j, '$.cooling_events') AS JSON[])), generate_subscripts(CAST(json_extract(j, '$.cooling_events') AS JSON[]), 1) - 1 FROM clean
 UNION ALL SELECT id, 'revive', unnest(CAST(json_extract(j, '$.reviving_events') AS JSON[])), generate_subscripts(CAST(json_extract(j, '$.reviving_events') AS JSON[]), 1) - 1 FROM clean
 UNION ALL SELECT id, 'new', unnest(CAST(json_extract(j, '$.new_events') AS JSON[])), generate_subscripts(CAST(json_extract(j, '$.new_events') AS JSON[]), 1) - 1 FROM clean) e),
named AS (SELECT *, CASE WHEN kind IN ('cool', 'revive') THEN CAST(try_cast(json_extract_string(x, '$') AS DOUBLE) AS BIGINT) END AS story FROM exploded),
read AS (SELECT id, place, CASE WHEN kind IN ('cool', 'revive') AND story IS NULL THEN 'error' ELSE kind END AS kind,
 CASE WHEN kind NOT IN ('cool', 'revive') THEN x WHEN story IS NULL THEN json_extract_string(x, '$') ELSE '{{"event_id":' || story || '}}' END AS payload,
 CASE kind WHEN 'merge' THEN json_extract_string(x, '$.reason') WHEN 'split' THEN 'split: ' || json_extract_string(x, '$.suggested_new_name') WHEN 'new' THEN json_extract_string(x, '$.name')
  WHEN 'cool' THEN CASE WHEN story IS NULL THEN 'unreadable element of cooling_events' END END AS rationale FROM named
 UNION ALL SELECT r.id, NULL, 'error', r.content, 'unreadable answer' FROM recluster_responses r JOIN clean c ON c.id = r.id WHERE c.j IS NULL),
proposed AS (SELECT * FROM read WHERE kind <> 'error')"""
_DIFF = _DIFF.replace("'{{\"event_id\":'", "'{\"event_id\":'").replace("|| '}}' END AS payload", "|| '}' END AS payload")


@query("parse_recluster_diff", f"WITH {_DIFF} SELECT id, place, kind, payload, rationale FROM read")
def _(t):
    return payloads.parse_recluster_diff(t.recluster_responses)


@query("write_proposals", f"""WITH {_DIFF} SELECT id, kind, payload, applied FROM recluster_proposals
UNION ALL SELECT {_new_ids('recluster_proposals', "CAST(p.id AS VARCHAR) || ':' || p.kind || ':' || CAST(p.place AS VARCHAR)")}, p.kind, p.payload, 0 FROM proposed p""")
def _(t):
    parsed = payloads.parse_recluster_diff(t.recluster_responses)
    return payloads.write_proposals(t.recluster_proposals, parsed, NOW).select("id", "kind", "payload", "applied")


_ASKED = "asked AS (SELECT id, CAST(json_extract_string(payload, '$.event_id') AS BIGINT) AS event_id, kind FROM recluster_proposals WHERE applied = 0 AND kind IN ('cool', 'revive')), per_story AS (SELECT event_id, arg_max(kind, id) AS last, bool_or(kind = 'revive') AS revived FROM asked GROUP BY event_id)"


@query("apply_proposals_stories", f"""WITH {_ASKED} SELECT s.id, CASE p.last WHEN 'cool' THEN 'cooling' WHEN 'revive' THEN 'active' ELSE s.status END AS status, CASE WHEN p.revived THEN NULL ELSE s.archived_at END AS archived_at,
 CASE WHEN p.revived THEN {_EXPIRY} ELSE s.expires_at END AS expires_at FROM stories s LEFT JOIN per_story p ON p.event_id = s.id""")
def _(t):
    return payloads.apply_proposals(t.stories, t.recluster_proposals, NOW)[0].select("id", "status", "archived_at", "expires_at")


@query("apply_proposals_marks", "SELECT id, CASE WHEN applied = 0 AND kind IN ('cool', 'revive') THEN 1 ELSE applied END AS applied, CASE WHEN applied = 0 AND kind IN ('cool', 'revive') THEN {NOW} END AS applied_at FROM recluster_proposals")
def _(t):
    return payloads.apply_proposals(t.stories, t.recluster_proposals, NOW)[1].select("id", "applied", "applied_at")


@query("parse_summaries", f"""WITH base AS (SELECT r.id, {_fenced('r.content')} AS content, e.summary_json FROM summary_responses r JOIN event_summaries e ON e.id = r.id)
SELECT id, CASE WHEN json_valid(content) THEN content WHEN id % 4 = 1 AND summary_json <> '{{}}' THEN summary_json END AS summary_json FROM base""")
def _(t):
    return payloads.parse_summaries(t.summary_responses)


# --- proposals of our own ----------------------------------------------------

_CENTROIDS = """means AS (SELECT a.event_id, i, avg(CAST(v.embedding[i] AS DOUBLE)) AS m FROM articles a JOIN embeddings v ON v.vec_id = a.id, generate_series(1, 64) g(i) WHERE a.event_id IS NOT NULL GROUP BY a.event_id, i),
centroids AS (SELECT event_id, list(m ORDER BY i) AS c FROM means GROUP BY event_id)"""
_COSINE = "list_cosine_similarity({}, {})"


@query("story_centroids", f"WITH {_CENTROIDS} SELECT event_id, i - 1 AS place, round(m, 6) AS value FROM means")
def _(t):
    return proposing.story_centroids(t.articles, t.raw("embeddings")).select("event_id", F.posexplode("centroid").alias("place", "value"))


@query("propose_assignments", f"""WITH {_CENTROIDS},
near AS (SELECT a.id, c.event_id, {_COSINE.format('CAST(v.embedding AS DOUBLE[])', 'c.c')} AS cosine FROM articles a JOIN embeddings v ON v.vec_id = a.id, centroids c JOIN stories s ON s.id = c.event_id WHERE a.event_id IS NULL AND s.status IN ('active', 'cooling')
 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY cosine DESC, c.event_id) = 1),
judged AS (SELECT a.id, coalesce(a.importance_score, 0.5) AS importance_score, n.event_id, n.cosine, coalesce(n.cosine >= 0.3 AND ({article_type('a.title', 'a.rss_description', 'a.scraped_text_content')} = 'news' OR (SELECT count(*) FROM articles x WHERE x.event_id = n.event_id) >= 3), false) AS fits
 FROM articles a LEFT JOIN near n ON n.id = a.id WHERE a.event_id IS NULL)
SELECT id AS pos, id AS article_id, CASE WHEN fits THEN 'existing' ELSE 'uncategorized' END AS decision, CASE WHEN fits THEN event_id END AS event_id, CAST(NULL AS VARCHAR) AS event_name, round(importance_score, 6) AS importance_score, round(CASE WHEN fits THEN cosine ELSE 0 END, 6) AS confidence FROM judged""")
def _(t):
    return proposing.propose_assignments(t.articles, t.stories, t.raw("embeddings"), threshold=0.3)


@query("propose_cooling", "SELECT id AS event_id FROM stories WHERE status = 'active' AND coalesce(last_article_at < {NOW} - INTERVAL '3' DAY, true)")
def _(t):
    return proposing.propose_cooling(t.stories, NOW)


@query("propose_revivals", f"""WITH {_CENTROIDS},
near AS (SELECT a.id, c.event_id, {_COSINE.format('CAST(v.embedding AS DOUBLE[])', 'c.c')} AS cosine FROM articles a JOIN embeddings v ON v.vec_id = a.id, centroids c JOIN stories s ON s.id = c.event_id
 WHERE a.event_id IS NULL AND a.published_date >= {{NOW}} - INTERVAL '14' DAY AND s.status = 'archived' AND s.archived_at >= {{NOW}} - INTERVAL '120' DAY QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY cosine DESC, c.event_id) = 1)
SELECT event_id, count(*) AS evidence, round(max(cosine), 6) AS best_cosine FROM near WHERE cosine >= -1 GROUP BY event_id""")
def _(t):
    return proposing.propose_revivals(t.articles, t.stories, t.raw("embeddings"), NOW, threshold=-1.0, revive_days=120)


@query("propose_duplicates", rf"""WITH {_CENTROIDS},
named AS (SELECT id, created_at, list_sort(list_distinct(string_split({_norm('name')}, ' '))) AS tokens FROM stories WHERE status IN ('active', 'cooling')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tokens ORDER BY created_at, id) AS rn FROM named),
pairs AS (SELECT r.id AS older_id, o.id AS newer_id, 1.0e0 AS overlap FROM ranked r JOIN ranked o ON o.tokens = r.tokens AND r.rn = 1 AND o.rn > 1
 UNION ALL SELECT a.id, b.id, len(list_intersect(a.tokens, b.tokens)) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE) FROM ranked a JOIN ranked b ON a.rn = 1 AND b.rn = 1 AND (a.created_at, a.id) < (b.created_at, b.id)),
scored AS (SELECT older_id, newer_id, CASE WHEN x.c IS NULL OR y.c IS NULL THEN overlap ELSE 0.7e0 * overlap + 0.3e0 * {_COSINE.format('x.c', 'y.c')} END AS confidence
 FROM pairs LEFT JOIN centroids x ON x.event_id = older_id LEFT JOIN centroids y ON y.event_id = newer_id WHERE overlap >= 0.7e0)
SELECT older_id, newer_id, round(confidence, 6) AS confidence FROM scored WHERE confidence >= 0.7e0""")
def _(t):
    return proposing.propose_duplicates(t.stories, t.articles, t.raw("embeddings"))


_WORDS = r"regexp_extract_all(lower(scraped_text_content), '[\p{L}\p{N}_]+')"


@query("propose_new_clusters", rf"""WITH RECURSIVE waiting AS (SELECT id, title, published_date, coalesce(importance_score, 0.5) AS importance_score, {_WORDS} AS w FROM articles WHERE event_id IS NULL),
cut AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM waiting WHERE len(w) > 0),
sized AS (SELECT id, count(*) AS n FROM cut GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM cut a JOIN cut b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM common c JOIN sized x ON x.id = a JOIN sized y ON y.id = b WHERE 2 * c.n >= x.n + y.n - c.n),
reach AS (SELECT id, id AS other FROM sized UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
groups AS (SELECT root, count(*) AS size, arg_min(title, (coalesce(published_date, TIMESTAMP '9999-12-31'), w.id)) FILTER (WHERE coalesce(title, '') <> '') AS name FROM waiting w JOIN roots USING (id) GROUP BY root),
placed AS (SELECT w.id, w.importance_score, r.root, name, coalesce(size >= 2, false) AS now FROM waiting w LEFT JOIN roots r ON r.id = w.id LEFT JOIN groups g ON g.root = r.root)
SELECT id AS pos, id AS article_id, CASE WHEN now THEN 'new' ELSE 'uncategorized' END AS decision, CAST(NULL AS BIGINT) AS event_id, CASE WHEN now THEN coalesce(name, 'Untitled story ' || root) END AS event_name,
 round(importance_score, 6) AS importance_score, 1.0e0 AS confidence, root FROM placed""")
def _(t):
    return proposing.propose_new_clusters(t.articles)
