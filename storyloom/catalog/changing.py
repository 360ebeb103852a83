"""Lifecycle, editor corrections, merges and visitor state."""

from pyspark.sql import functions as F

from storyloom.catalog.registry import NOW, query
from storyloom.operators import corrections, lifecycle, maintained, merging

_S = ["id", "status", "last_article_at", "archived_at", "expires_at"]
_EXPIRY = "{NOW} + INTERVAL '48' HOUR"
_EXPIRED = "status = 'active' AND expires_at < {NOW}"
_REAPED = f"""reaped AS (SELECT id, name, created_at, last_article_at, expires_at, CASE WHEN {_EXPIRED} THEN 'archived' ELSE status END AS status,
 CASE WHEN {_EXPIRED} THEN {{NOW}} ELSE archived_at END AS archived_at FROM stories)"""


def _new_ids(source: str, key: str) -> str:
    return f"(SELECT max(id) FROM {source}) + row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR)))"


# --- lifecycle ---------------------------------------------------------------


@query("reap_expired", f"WITH {_REAPED} SELECT id, status, last_article_at, archived_at, expires_at FROM reaped")
def _(t):
    return lifecycle.reap_expired(t.stories, NOW).select(*_S)


@query("reset_expiry", f"SELECT id, CASE WHEN status = 'active' THEN {_EXPIRY} ELSE expires_at END AS expires_at FROM stories")
def _(t):
    return lifecycle.reset_active_expiry(t.stories, NOW).select("id", "expires_at")


@query("backfill_expiry", f"SELECT id, coalesce(expires_at, {_EXPIRY}) AS expires_at FROM stories")
def _(t):
    return lifecycle.backfill_expiry(t.stories, NOW).select("id", "expires_at")


@query("purge_empty", """
SELECT id FROM stories WHERE id NOT IN (SELECT s.id FROM stories s WHERE s.created_at < {NOW} - INTERVAL '30' SECOND AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.event_id = s.id))""")
def _(t):
    return lifecycle.purge_empty(t.stories, t.articles, NOW).select("id")


@query("purge_ancient", """
SELECT id FROM stories WHERE id NOT IN (SELECT id FROM stories WHERE status = 'archived' AND archived_at < {NOW} - INTERVAL '180' DAY)""")
def _(t):
    return lifecycle.purge_ancient(t.stories, NOW).select("id")


@query("purge_proposals", "SELECT id, created_at FROM recluster_proposals WHERE created_at >= {NOW} - INTERVAL '180' DAY")
def _(t):
    return lifecycle.purge_proposals(t.recluster_proposals, NOW).select("id", "created_at")


_TICK = f"""{_REAPED},
hollow AS (SELECT s.id FROM reaped s WHERE s.created_at < {{NOW}} - INTERVAL '30' SECOND AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.event_id = s.id)),
ancient AS (SELECT id FROM reaped WHERE id NOT IN (SELECT id FROM hollow) AND status = 'archived' AND archived_at < {{NOW}} - INTERVAL '180' DAY)"""


@query("lifecycle_tick_stories", f"WITH {_TICK} SELECT id, status, last_article_at, archived_at, expires_at FROM reaped WHERE id NOT IN (SELECT id FROM hollow) AND id NOT IN (SELECT id FROM ancient)")
def _(t):
    return lifecycle.lifecycle_tick(t.stories, t.articles, t.recluster_proposals, NOW).stories.select(*_S)


@query("lifecycle_tick_articles", f"WITH {_TICK} SELECT a.id, CASE WHEN event_id IN (SELECT id FROM hollow UNION ALL SELECT id FROM ancient) THEN NULL ELSE event_id END AS event_id FROM articles a")
def _(t):
    return lifecycle.lifecycle_tick(t.stories, t.articles, t.recluster_proposals, NOW).articles.select("id", "event_id")


@query("tick_counts", f"""WITH {_TICK} SELECT * FROM (SELECT 'reaped' AS outcome, count(*) AS n FROM stories WHERE {_EXPIRED}
 UNION ALL SELECT 'purged_empty', count(*) FROM hollow UNION ALL SELECT 'purged', count(*) FROM ancient) c WHERE n > 0""")
def _(t):
    return lifecycle.lifecycle_tick(t.stories, t.articles, t.recluster_proposals, NOW).counts


@query("revive", f"""
SELECT id, CASE WHEN hit THEN 'active' ELSE status END AS status, last_article_at, CASE WHEN hit THEN NULL ELSE archived_at END AS archived_at, CASE WHEN hit THEN {_EXPIRY} ELSE expires_at END AS expires_at
FROM (SELECT *, status = 'archived' AND id IN (SELECT event_id FROM event_visits) AS hit FROM stories) s""")
def _(t):
    return lifecycle.revive(t.stories, t.event_visits.select(F.col("event_id").alias("id")), NOW).select(*_S)


@query("revive_recent", f"""
SELECT id, CASE WHEN hit THEN 'active' ELSE status END AS status, last_article_at, CASE WHEN hit THEN NULL ELSE archived_at END AS archived_at, CASE WHEN hit THEN {_EXPIRY} ELSE expires_at END AS expires_at
FROM (SELECT *, coalesce(status = 'archived' AND last_article_at >= {{NOW}} - INTERVAL '7' DAY, false) AS hit FROM stories) s""")
def _(t):
    return lifecycle.revive_recent(t.stories, NOW).select(*_S)


# --- moves, removals, merges, splits -----------------------------------------

_MOVES = """
req AS (SELECT m.*, a.id AS aid, a.event_id AS cur, a.published_date AS pub, s.id AS sid, m.from_event_id IS NULL AS is_add, nullif(trim(m.new_name), '') AS story_name
 FROM moves m LEFT JOIN articles a ON a.id = m.article_id LEFT JOIN stories s ON s.id = m.to_event_id),
judged AS (SELECT *, CASE WHEN aid IS NULL THEN 'no_article' WHEN NOT is_add AND cur IS DISTINCT FROM from_event_id THEN 'wrong_source'
 WHEN to_event_id IS NULL AND (is_add OR story_name IS NULL) THEN 'no_target' WHEN to_event_id IS NOT NULL AND sid IS NULL THEN 'no_target' END AS bad FROM req),
outcomes AS (SELECT *, coalesce(bad, CASE WHEN pos = max(CASE WHEN bad IS NULL THEN pos END) OVER (PARTITION BY article_id) THEN 'applied' ELSE 'superseded' END) AS outcome FROM judged),
named AS (SELECT pos, story_name, """ + _new_ids("stories", "pos") + """ AS new_id FROM outcomes WHERE outcome = 'applied' AND to_event_id IS NULL),
placed AS (SELECT o.*, coalesce(o.to_event_id, n.new_id) AS target FROM outcomes o LEFT JOIN named n ON n.pos = o.pos WHERE o.outcome = 'applied')"""


def _moved(t):
    return corrections.apply_moves(t.articles, t.stories, t.moves, NOW)


@query("maintained_rollup", f"""WITH {_MOVES},
after AS (SELECT a.id, coalesce(p.target, a.event_id) AS event_id, feed_source_id, importance_score FROM articles a LEFT JOIN placed p ON p.article_id = a.id)
SELECT event_id, count(*) AS article_count, count(DISTINCT feed_source_id) AS feed_count, round(coalesce(avg(importance_score), 0), 6) AS importance_avg FROM after WHERE event_id IS NOT NULL GROUP BY event_id""")
def _(t):
    """The roll-up of the tables as they are, brought up to date by the moved articles alone."""
    asked = t.moves.select(F.col("article_id").alias("id")).distinct()
    before, after = (rows.join(asked, "id", "left_semi") for rows in (t.articles, _moved(t).articles))
    return maintained.story_totals(maintained.maintained(maintained.kept_rollup(t.articles), maintained.rollup_changes(before, after)))


@query("apply_moves_articles", f"WITH {_MOVES} SELECT a.id, CASE WHEN p.pos IS NULL THEN a.event_id ELSE p.target END AS event_id, CASE WHEN p.pos IS NOT NULL THEN {{NOW}} END AS grouped_at FROM articles a LEFT JOIN placed p ON p.article_id = a.id")
def _(t):
    return _moved(t).articles.select("id", "event_id", "grouped_at")


@query("apply_moves_stories", f"""WITH {_MOVES},
changes AS (SELECT target, max(CASE WHEN is_add THEN pub END) AS newest, arg_min(coalesce(pub, {{NOW}}), pos) FILTER (WHERE is_add) AS first_add, bool_or(is_add) AS added FROM placed WHERE to_event_id IS NOT NULL GROUP BY target)
SELECT s.id, s.name, CASE WHEN c.added THEN 'active' ELSE s.status END AS status, CASE WHEN c.added THEN greatest(coalesce(s.last_article_at, c.first_add), c.newest) ELSE s.last_article_at END AS last_article_at,
 CASE WHEN c.added THEN NULL ELSE s.archived_at END AS archived_at, CASE WHEN c.target IS NOT NULL THEN {_EXPIRY} ELSE s.expires_at END AS expires_at FROM stories s LEFT JOIN changes c ON c.target = s.id
UNION ALL SELECT new_id, story_name, 'active', NULL, NULL, {_EXPIRY} FROM named""")
def _(t):
    return _moved(t).stories.select("id", "name", "status", "last_article_at", "archived_at", "expires_at")


@query("apply_moves_feedback", f"WITH {_MOVES} SELECT article_id, coalesce(from_event_id, cur) AS original_event_id, target AS corrected_event_id, 'move' AS kind, note FROM placed")
def _(t):
    return _moved(t).feedback.drop("created_at")


@query("apply_moves_log", f"WITH {_MOVES} SELECT pos, outcome FROM outcomes")
def _(t):
    return _moved(t).log


_REMOVALS = """
valid AS (SELECT r.event_id, r.article_id, min(r.pos) AS pos FROM removals r JOIN articles a ON a.id = r.article_id AND a.event_id = r.event_id JOIN stories s ON s.id = r.event_id GROUP BY r.event_id, r.article_id),
disbanded AS (SELECT a.event_id AS id FROM articles a JOIN (SELECT event_id, count(*) AS n FROM valid GROUP BY event_id) v ON v.event_id = a.event_id GROUP BY a.event_id HAVING count(*) - any_value(v.n) < 2),
free AS (SELECT a.id FROM articles a WHERE a.event_id IN (SELECT id FROM disbanded) OR a.id IN (SELECT article_id FROM valid))"""


def _removed(t):
    return corrections.apply_removals(t.articles, t.stories, t.event_summaries, t.removals, NOW)


@query("apply_removals_articles", f"WITH {_REMOVALS} SELECT a.id, CASE WHEN f.id IS NULL THEN a.event_id END AS event_id, CASE WHEN f.id IS NULL THEN a.proposed_event_name END AS proposed_event_name FROM articles a LEFT JOIN free f ON f.id = a.id")
def _(t):
    return _removed(t)[0].articles.select("id", "event_id", "proposed_event_name")


@query("apply_removals_stories", f"WITH {_REMOVALS} SELECT id FROM stories WHERE id NOT IN (SELECT id FROM disbanded)")
def _(t):
    return _removed(t)[0].stories.select("id")


@query("apply_removals_summaries", f"WITH {_REMOVALS} SELECT id, event_id FROM event_summaries WHERE event_id NOT IN (SELECT id FROM disbanded)")
def _(t):
    return _removed(t)[1].select("id", "event_id")


@query("apply_removals_log", f"WITH {_REMOVALS} SELECT r.pos, CASE WHEN v.pos IS NULL THEN 'not_in_story' ELSE 'removed' END AS outcome FROM removals r LEFT JOIN valid v ON v.pos = r.pos")
def _(t):
    return _removed(t)[0].log


def _fold(source: str) -> str:
    """Take ordered (pos, keep, dropped) pairs one by one; the state is the list of dropped ids."""
    return f"""
numbered AS (SELECT pos, keep, dropped, row_number() OVER (ORDER BY pos) AS i FROM {source}),
fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS removed, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS keep, CAST(NULL AS BIGINT) AS dropped, false AS accepted
 UNION ALL SELECT n.i, CASE WHEN ok THEN list_append(removed, n.dropped) ELSE removed END, n.pos, n.keep, n.dropped, ok FROM
  (SELECT n.*, f.removed, n.keep <> n.dropped AND NOT list_contains(f.removed, n.keep) AND NOT list_contains(f.removed, n.dropped) AS ok FROM fold f JOIN numbered n ON n.i = f.i + 1) n),
accepted AS (SELECT pos, keep, dropped FROM fold WHERE accepted),
hops AS (SELECT dropped, keep, 1 AS depth FROM accepted UNION ALL SELECT h.dropped, a.keep, h.depth + 1 FROM hops h JOIN accepted a ON a.dropped = h.keep),
links AS (SELECT dropped, arg_max(keep, depth) AS keep FROM hops GROUP BY dropped)"""


_MANUAL = f"""fit AS (SELECT m.pos, m.primary_id AS keep, m.secondary_id AS dropped FROM manual_merges m JOIN stories p ON p.id = m.primary_id JOIN stories s ON s.id = m.secondary_id WHERE m.primary_id <> m.secondary_id), {_fold('fit')}"""


def _merged_by_hand(t):
    return corrections.apply_merges_manual(t.articles, t.stories, t.manual_merges, NOW)


@query("apply_merges_manual_articles", f"WITH RECURSIVE {_MANUAL} SELECT a.id, coalesce(l.keep, a.event_id) AS event_id FROM articles a LEFT JOIN links l ON l.dropped = a.event_id")
def _(t):
    return _merged_by_hand(t).articles.select("id", "event_id")


@query("apply_merges_manual_stories", f"WITH RECURSIVE {_MANUAL} SELECT id, status, last_article_at, archived_at, expires_at FROM stories WHERE id NOT IN (SELECT dropped FROM links)")
def _(t):
    return _merged_by_hand(t).stories.select(*_S)


@query("apply_merges_manual_feedback", f"""WITH RECURSIVE {_MANUAL} SELECT 0 AS article_id, a.dropped AS original_event_id, a.keep AS corrected_event_id, 'merge' AS kind,
 coalesce(nullif(m.note, ''), 'merged ''' || s.name || ''' into ''' || p.name || '''') AS note FROM accepted a JOIN manual_merges m ON m.pos = a.pos JOIN stories p ON p.id = a.keep JOIN stories s ON s.id = a.dropped""")
def _(t):
    return _merged_by_hand(t).feedback.drop("created_at")


@query("apply_merges_manual_log", f"WITH RECURSIVE {_MANUAL} SELECT m.pos, CASE WHEN m.primary_id = m.secondary_id THEN 'self_merge' WHEN a.pos IS NOT NULL THEN 'merged' ELSE 'no_story' END AS outcome FROM manual_merges m LEFT JOIN accepted a ON a.pos = m.pos")
def _(t):
    return _merged_by_hand(t).log


_SPLITS = """
heads AS (SELECT DISTINCT p.pos, p.event_id, p.note, nullif(trim(p.new_name), '') AS story_name, s.name AS parent_name FROM splits p JOIN stories s ON s.id = p.event_id),
fresh AS (SELECT *, """ + _new_ids("stories", "pos") + """ AS new_id FROM heads WHERE story_name IS NOT NULL),
placed AS (SELECT a.id AS article_id, any_value(a.published_date) AS pub, arg_min(f.new_id, f.pos) AS target FROM splits p JOIN fresh f ON f.pos = p.pos JOIN articles a ON a.id = p.article_id AND a.event_id = p.event_id GROUP BY a.id)"""


def _split(t):
    return corrections.apply_splits(t.articles, t.stories, t.splits, NOW)


@query("apply_splits_articles", f"WITH {_SPLITS} SELECT a.id, coalesce(p.target, a.event_id) AS event_id FROM articles a LEFT JOIN placed p ON p.article_id = a.id")
def _(t):
    return _split(t).articles.select("id", "event_id")


@query("apply_splits_stories", f"""WITH {_SPLITS} SELECT id, name, status, last_article_at, expires_at FROM stories
UNION ALL SELECT f.new_id, f.story_name, 'active', d.last_article_at, {_EXPIRY} FROM fresh f LEFT JOIN (SELECT target, coalesce(max(pub), {{NOW}}) AS last_article_at FROM placed GROUP BY target) d ON d.target = f.new_id""")
def _(t):
    return _split(t).stories.select("id", "name", "status", "last_article_at", "expires_at")


@query("apply_splits_feedback", f"WITH {_SPLITS} SELECT 0 AS article_id, event_id AS original_event_id, new_id AS corrected_event_id, 'split' AS kind, coalesce(nullif(note, ''), 'split out ''' || story_name || ''' from ''' || parent_name || '''') AS note FROM fresh")
def _(t):
    return _split(t).feedback.drop("created_at")


_CHANGES = """
judged AS (SELECT c.*, CASE WHEN op = 'create' THEN CASE WHEN nullif(trim(c.name), '') IS NULL THEN 'no_name' ELSE 'created' END WHEN s.id IS NULL THEN 'no_story' WHEN op = 'delete' THEN 'deleted'
  WHEN c.status IS NOT NULL AND c.status NOT IN ('active', 'cooling', 'archived') THEN 'bad_status' ELSE 'updated' END AS outcome FROM story_changes c LEFT JOIN stories s ON s.id = c.event_id),
edits AS (SELECT event_id, arg_max(trim(name), pos) FILTER (WHERE name IS NOT NULL) AS new_name, arg_max(status, pos) FILTER (WHERE status IS NOT NULL) AS new_status,
  arg_max(status, pos) FILTER (WHERE status IN ('active', 'archived')) AS stamp FROM judged WHERE outcome = 'updated' GROUP BY event_id),
gone AS (SELECT event_id FROM judged WHERE outcome = 'deleted')"""


def _changed(t):
    return corrections.apply_story_changes(t.articles, t.stories, t.story_changes, NOW)


@query("apply_story_changes_stories", f"""WITH {_CHANGES} SELECT s.id, coalesce(e.new_name, s.name) AS name, coalesce(e.new_status, s.status) AS status,
 CASE e.stamp WHEN 'archived' THEN {{NOW}} WHEN 'active' THEN NULL ELSE s.archived_at END AS archived_at, s.expires_at FROM stories s LEFT JOIN edits e ON e.event_id = s.id WHERE s.id NOT IN (SELECT event_id FROM gone)
UNION ALL SELECT {_new_ids('stories', 'pos')}, trim(name), 'active', NULL, {_EXPIRY} FROM judged WHERE outcome = 'created'""")
def _(t):
    return _changed(t).stories.select("id", "name", "status", "archived_at", "expires_at")


@query("apply_story_changes_articles", f"WITH {_CHANGES} SELECT a.id, CASE WHEN event_id IN (SELECT event_id FROM gone) THEN NULL ELSE event_id END AS event_id FROM articles a")
def _(t):
    return _changed(t).articles.select("id", "event_id")


@query("apply_story_changes_log", f"WITH {_CHANGES} SELECT pos, outcome FROM judged")
def _(t):
    return _changed(t).log


_FEEDS = """
adds AS (SELECT pos, trim(url) AS url, name, fetch_interval_minutes, regexp_matches(trim(url), '^https?://') AS web FROM feed_changes WHERE op = 'add'),
asked AS (SELECT a.url, arg_min(a.name, a.pos) AS name, arg_max(a.fetch_interval_minutes, a.pos) FILTER (WHERE a.fetch_interval_minutes IS NOT NULL) AS minutes, any_value(f.id) AS known_id
  FROM adds a LEFT JOIN feed_sources f ON f.url = a.url WHERE web GROUP BY a.url),
firsts AS (SELECT url, name FROM adds WHERE web QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1),
edits AS (SELECT c.*, f.id IS NOT NULL AS known FROM feed_changes c LEFT JOIN feed_sources f ON f.id = c.feed_id WHERE op <> 'add'),
last_interval AS (SELECT feed_id, arg_max(fetch_interval_minutes, pos) AS minutes FROM edits WHERE known AND op = 'interval' GROUP BY feed_id),
last_toggle AS (SELECT feed_id, arg_max(op, pos) AS op FROM edits WHERE known AND op IN ('pause', 'unpause') GROUP BY feed_id),
gone AS (SELECT feed_id FROM edits WHERE known AND op = 'remove')"""


def _feeds_changed(t):
    return corrections.apply_feed_changes(t.feed_sources, t.articles, t.feed_changes, NOW)


@query("apply_feed_changes_feeds", f"""WITH {_FEEDS} SELECT f.id, f.url, f.name, coalesce(i.minutes, f.fetch_interval_minutes) AS fetch_interval_minutes, CASE WHEN o.op IS NULL THEN f.is_paused ELSE o.op = 'pause' END AS is_paused
 FROM feed_sources f LEFT JOIN last_interval i ON i.feed_id = f.id LEFT JOIN last_toggle o ON o.feed_id = f.id WHERE f.id NOT IN (SELECT feed_id FROM gone)
UNION ALL SELECT {_new_ids('feed_sources', 'a.url')}, a.url, coalesce(nullif(n.name, ''), replace(split_part(a.url, '/', 3), 'www.', '')), coalesce(a.minutes, 30), false FROM asked a JOIN firsts n ON n.url = a.url WHERE a.known_id IS NULL""")
def _(t):
    return _feeds_changed(t)[0].select("id", "url", "name", "fetch_interval_minutes", "is_paused")


@query("apply_feed_changes_articles", f"WITH {_FEEDS} SELECT id, CASE WHEN feed_source_id IN (SELECT feed_id FROM gone) THEN NULL ELSE feed_source_id END AS feed_source_id FROM articles")
def _(t):
    return _feeds_changed(t)[1].select("id", "feed_source_id")


@query("apply_feed_changes_log", f"WITH {_FEEDS} SELECT pos, CASE WHEN web THEN 'added' ELSE 'bad_url' END AS outcome FROM adds UNION ALL SELECT pos, CASE WHEN known THEN op ELSE 'no_feed' END FROM edits")
def _(t):
    return _feeds_changed(t)[2]


_DISBAND = """gone AS (SELECT s.id, s.name, count(*) AS n FROM stories s JOIN articles a ON a.event_id = s.id GROUP BY s.id, s.name HAVING count(*) <= 2 AND count(DISTINCT coalesce(a.publisher_name, '')) <= 1)"""


def _disbanded(t):
    return corrections.disband_same_source(t.articles, t.stories, t.event_summaries, NOW)


@query("disband_same_source_articles", f"WITH {_DISBAND} SELECT a.id, CASE WHEN g.id IS NULL THEN a.event_id END AS event_id, CASE WHEN g.id IS NULL THEN a.proposed_event_name ELSE g.name END AS proposed_event_name FROM articles a LEFT JOIN gone g ON g.id = a.event_id")
def _(t):
    return _disbanded(t)[0].articles.select("id", "event_id", "proposed_event_name")


@query("disband_same_source_stories", f"WITH {_DISBAND} SELECT id FROM stories WHERE id NOT IN (SELECT id FROM gone)")
def _(t):
    return _disbanded(t)[0].stories.select("id")


@query("append_feedback", f"""WITH {_SPLITS} SELECT kind, article_id, original_event_id, corrected_event_id FROM grouping_feedback UNION ALL SELECT 'split', 0, event_id, new_id FROM fresh""")
def _(t):
    from storyloom.operators.updates import append_feedback

    return append_feedback(t.grouping_feedback, _split(t).feedback).select("kind", "article_id", "original_event_id", "corrected_event_id")


_CHAT = "complete AS (SELECT pos, event_id, visitor_id, trim(question) AS question, trim(answer) AS answer, model_used FROM chat_turns WHERE trim(question) <> '' AND trim(answer) <> '' AND event_id IN (SELECT id FROM stories))"


@query("append_chat_turns", f"""WITH {_CHAT}, fresh AS (SELECT CAST(pos AS VARCHAR) || ':user' AS k, event_id, visitor_id, 'user' AS role, question AS content FROM complete
 UNION ALL SELECT CAST(pos AS VARCHAR) || ':assistant', event_id, visitor_id, 'assistant', answer FROM complete)
SELECT id, event_id, visitor_id, role, content FROM event_chat_messages UNION ALL SELECT {_new_ids('event_chat_messages', 'k')}, event_id, visitor_id, role, content FROM fresh""")
def _(t):
    return corrections.append_chat_turns(t.event_chat_messages, t.stories, t.chat_turns, NOW).select("id", "event_id", "visitor_id", "role", "content")


# --- visitor state -----------------------------------------------------------


@query("mark_read", """
SELECT visitor_id, article_id, read_at FROM article_reads UNION ALL
SELECT r.visitor_id, r.article_id, arg_min(r.at, r.pos) FROM read_requests r JOIN articles a ON a.id = r.article_id
WHERE NOT EXISTS (SELECT 1 FROM article_reads x WHERE x.visitor_id = r.visitor_id AND x.article_id = r.article_id) GROUP BY r.visitor_id, r.article_id""")
def _(t):
    return corrections.mark_read(t.article_reads, t.articles, t.read_requests)


@query("mark_unread", "SELECT visitor_id, article_id, read_at FROM article_reads x WHERE NOT EXISTS (SELECT 1 FROM read_requests r WHERE r.visitor_id = x.visitor_id AND r.article_id = x.article_id)")
def _(t):
    return corrections.mark_unread(t.article_reads, t.read_requests).select("visitor_id", "article_id", "read_at")


@query("mark_all_read", """
SELECT r.visitor_id, a.id AS article_id, a.event_id FROM story_requests r JOIN articles a ON a.event_id = r.event_id
WHERE NOT EXISTS (SELECT 1 FROM article_reads x WHERE x.visitor_id = r.visitor_id AND x.article_id = a.id)""")
def _(t):
    return corrections.mark_all_read(t.article_reads, t.articles, t.story_requests, NOW).select("visitor_id", "article_id", "event_id")


@query("mark_visited", """
SELECT visitor_id, event_id, max(seen) AS last_visited_at FROM (SELECT visitor_id, event_id, last_visited_at AS seen FROM event_visits
 UNION ALL SELECT visitor_id, event_id, "at" FROM visit_requests WHERE event_id IN (SELECT id FROM stories)) x GROUP BY 1, 2""")
def _(t):
    return corrections.mark_visited(t.event_visits, t.stories, t.visit_requests)


# --- merging -----------------------------------------------------------------

_PAIRS = f"""
typed AS (SELECT pos, try_cast(older_id AS BIGINT) AS keep, try_cast(newer_id AS BIGINT) AS dropped, coalesce(try_cast(confidence AS DOUBLE), CASE WHEN confidence IS NULL THEN 0 END) AS confidence, reason FROM merge_pairs),
fit AS (SELECT * FROM typed WHERE confidence >= 0.7e0 AND keep IN (SELECT id FROM stories WHERE status IN ('active', 'cooling')) AND dropped IN (SELECT id FROM stories WHERE status IN ('active', 'cooling'))), {_fold('fit')},
outcomes AS (SELECT t.pos, t.keep, t.dropped, CASE WHEN a.pos IS NOT NULL THEN 'merged' WHEN f.pos IS NOT NULL AND t.keep = t.dropped AND NOT EXISTS (SELECT 1 FROM accepted x WHERE x.dropped = t.keep AND x.pos < t.pos) THEN 'ignored' ELSE 'skipped' END AS outcome
 FROM typed t LEFT JOIN accepted a ON a.pos = t.pos LEFT JOIN fit f ON f.pos = t.pos)"""


@query("accept_merge_pairs", f"WITH RECURSIVE {_PAIRS} SELECT pos, keep, dropped AS \"drop\", outcome FROM outcomes")
def _(t):
    return merging.accept_merge_pairs(t.merge_pairs, t.stories).select("pos", "keep", "drop", "outcome")


@query("dedup_counts", f"WITH RECURSIVE {_PAIRS} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def _(t):
    from storyloom.operators.rollups import outcome_counts

    return outcome_counts(merging.accept_merge_pairs(t.merge_pairs, t.stories))


@query("merge_stories_articles", f"WITH RECURSIVE {_PAIRS} SELECT a.id, coalesce(l.keep, a.event_id) AS event_id FROM articles a LEFT JOIN links l ON l.dropped = a.event_id")
def _(t):
    return merging.dedup_events(t.articles, t.stories, t.merge_pairs, NOW)[0].articles.select("id", "event_id")


@query("merge_stories_stories", f"""WITH RECURSIVE {_PAIRS},
newest AS (SELECT l.keep, max(a.published_date) AS newest FROM links l LEFT JOIN articles a ON a.event_id = l.dropped GROUP BY l.keep)
SELECT s.id, CASE WHEN n.keep IS NULL THEN s.status ELSE 'active' END AS status, CASE WHEN n.keep IS NULL THEN s.last_article_at ELSE greatest(s.last_article_at, n.newest) END AS last_article_at,
 CASE WHEN n.keep IS NULL THEN s.archived_at END AS archived_at, CASE WHEN n.keep IS NULL THEN s.expires_at ELSE {_EXPIRY} END AS expires_at
FROM stories s LEFT JOIN newest n ON n.keep = s.id WHERE s.id NOT IN (SELECT dropped FROM links)""")
def _(t):
    return merging.dedup_events(t.articles, t.stories, t.merge_pairs, NOW)[0].stories.select(*_S)


@query("merge_stories_feedback", f"WITH RECURSIVE {_PAIRS} SELECT 0 AS article_id, a.dropped AS original_event_id, a.keep AS corrected_event_id, 'dedup_merge' AS kind, 'llm: ' || t.reason AS note FROM accepted a JOIN typed t ON t.pos = a.pos")
def _(t):
    return merging.dedup_events(t.articles, t.stories, t.merge_pairs, NOW)[0].feedback.drop("created_at")


_NAMED = r"""
named AS (SELECT s.id, s.created_at, lower(trim(regexp_replace(s.name, '\s+', ' ', 'g'))) AS norm, (SELECT count(*) FROM articles a WHERE a.event_id = s.id) AS n FROM stories s),
primaries AS (SELECT norm, id AS primary_id FROM named QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, created_at, id) = 1),
actions AS (SELECT CASE WHEN n.n = 0 THEN 'delete_empty_phantom' ELSE 'merge' END AS action, p.primary_id, n.id AS secondary_id, n.n AS article_count FROM named n JOIN primaries p ON p.norm = n.norm WHERE n.id <> p.primary_id)"""


@query("primary_per_name", f"WITH {_NAMED} SELECT * FROM primaries")
def _(t):
    return merging.primary_per_name(t.stories, t.articles)


@query("dedup_by_name", f"WITH {_NAMED} SELECT * FROM actions")
def _(t):
    return merging.dedup_by_name(t.stories, t.articles)


@query("apply_dedup_by_name_articles", f"WITH {_NAMED} SELECT a.id, coalesce(x.primary_id, a.event_id) AS event_id FROM articles a LEFT JOIN actions x ON x.secondary_id = a.event_id AND x.action = 'merge'")
def _(t):
    return merging.apply_dedup_by_name(t.articles, t.stories, NOW).articles.select("id", "event_id")


@query("apply_dedup_by_name_stories", f"""WITH {_NAMED}, newest AS (SELECT x.primary_id, max(a.published_date) AS newest FROM actions x LEFT JOIN articles a ON a.event_id = x.secondary_id WHERE x.action = 'merge' GROUP BY x.primary_id)
SELECT s.id, CASE WHEN n.primary_id IS NULL THEN s.status ELSE 'active' END AS status, greatest(s.last_article_at, n.newest) AS last_article_at,
 CASE WHEN n.primary_id IS NULL THEN s.archived_at END AS archived_at, CASE WHEN n.primary_id IS NULL THEN s.expires_at ELSE {_EXPIRY} END AS expires_at
FROM stories s LEFT JOIN newest n ON n.primary_id = s.id WHERE s.id NOT IN (SELECT secondary_id FROM actions)""")
def _(t):
    return merging.apply_dedup_by_name(t.articles, t.stories, NOW).stories.select(*_S)
