"""Tables of record and request tables, derived from the raw test tables.

Each view is one SQL text that runs unchanged on Spark and on DuckDB but for
four placeholders: ``{S}`` (string type), ``{WC}`` (word count of ``d.text``),
``{G}`` (the flag that makes ``regexp_replace`` global) and ``{D}`` (the
documents where no text is read).  On Spark a view
becomes a DataFrame; in an oracle it is inlined as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ("documents", "labels", "pages", "events", "embeddings", "conversations")

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

_N = "(SELECT count(*) FROM {D})"
_LINE = "split_part(d.text, chr(10), 1)"
_WORDS = "regexp_replace({x}, '[^A-Za-z0-9 ]', ' '{G})"

VIEWS: dict[str, str] = {}

VIEWS["articles"] = f"""
SELECT d.doc_id AS id,
 CAST(substr(d.source, 4) AS BIGINT) AS feed_source_id,
 'http://' || d.source || '.example.com/' || CAST(d.doc_id AS {{S}}) AS url,
 CASE d.doc_id % 23
  WHEN 0 THEN 'Opinion: ' || {_LINE}
  WHEN 1 THEN 'How to ' || {_LINE}
  WHEN 2 THEN 'Some thing review'
  WHEN 3 THEN 'The Morning ' || {_LINE}
  WHEN 4 THEN 'Podcast: ' || {_LINE}
  WHEN 5 THEN 'Travel ' || {_LINE}
  WHEN 6 THEN 'Save 50 % off today'
  WHEN 7 THEN CAST(NULL AS {{S}})
  ELSE {_LINE} END AS title,
 CASE WHEN d.doc_id % 13 = 0 THEN CAST(NULL AS {{S}}) ELSE d.source END AS publisher_name,
 CASE WHEN d.doc_id % 29 = 0 THEN CAST(NULL AS TIMESTAMP)
  ELSE TIMESTAMP '2024-01-01 00:00:00' + CAST((d.doc_id * 7919) % 43200 AS INT) * INTERVAL '1' MINUTE END AS published_date,
 TIMESTAMP '2024-01-01 00:30:00' + CAST((d.doc_id * 7919) % 43200 AS INT) * INTERVAL '1' MINUTE AS fetched_at,
 CASE WHEN d.doc_id % 17 = 0 THEN 'This website uses essential cookies' WHEN d.doc_id % 19 = 0 THEN ''
  ELSE {_LINE} END AS rss_description,
 d.text AS scraped_text_content,
 CAST({{WC}} AS INT) AS word_count,
 CASE WHEN d.doc_id % 7 = 0 THEN CAST(NULL AS BIGINT)
  WHEN d.doc_id % 100 = 1 THEN 1000000 + d.doc_id - 1
  WHEN d.doc_id % 100 = 21 THEN 1000000 + d.doc_id - 21
  ELSE CAST(floor(sqrt(d.doc_id)) AS BIGINT) END AS event_id,
 CASE WHEN l.quality IS NULL THEN CAST(NULL AS DOUBLE)
  ELSE 0.5e0 * l.quality + 0.3e0 * l.toxic + 0.02e0 * (d.doc_id % 10) END AS importance_score,
 (d.doc_id % 100) / 100.0e0 AS grouping_confidence,
 CASE WHEN d.doc_id % 21 = 0 THEN 'Proposal ' || CAST(d.doc_id % 5 AS {{S}}) ELSE CAST(NULL AS {{S}}) END AS proposed_event_name
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
"""

VIEWS["stories"] = """
SELECT s.id,
 CASE WHEN s.id % 2 = 0 THEN 'Story ' ELSE '  story   ' END || CAST(s.id % 25 AS {S}) AS name,
 CASE s.id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'cooling' ELSE 'active' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(s.id % 500 AS INT) * INTERVAL '1' HOUR AS created_at,
 m.last_article_at,
 CASE WHEN s.id % 5 = 0 THEN TIMESTAMP '2023-07-01 00:00:00' + CAST((s.id % 1000) * 7 % 213 AS INT) * INTERVAL '1' DAY ELSE CAST(NULL AS TIMESTAMP) END AS archived_at,
 m.last_article_at + INTERVAL '48' HOUR AS expires_at
FROM (SELECT DISTINCT CAST(floor(sqrt(doc_id)) AS BIGINT) AS id FROM {D}
      UNION SELECT 1000000 + doc_id AS id FROM {D} WHERE doc_id % 50 = 0) s
LEFT JOIN (SELECT event_id, max(published_date) AS last_article_at FROM articles GROUP BY event_id) m ON m.event_id = s.id
"""

VIEWS["article_reads"] = f"""
SELECT user_id AS visitor_id, event_id % {_N} AS article_id, min(ts) AS read_at
FROM events WHERE event_type = 'view' GROUP BY 1, 2
"""

VIEWS["event_visits"] = f"""
SELECT user_id AS visitor_id, CAST(floor(sqrt(event_id % {_N})) AS BIGINT) AS event_id, max(ts) AS last_visited_at
FROM events WHERE event_type = 'click' GROUP BY 1, 2
"""

VIEWS["scrape_failures"] = """
SELECT 'http://src' || CAST(event_id % 20 AS {S}) || '.example.com/' || CASE WHEN event_id % 200 = 3 THEN 'feed' ELSE CAST(event_id % 400 AS {S}) END AS url,
 'HTTP ' || CAST(max(event_id % 600) AS {S}) AS error,
 count(*) AS attempt_count, min(ts) AS first_attempted_at, max(ts) AS last_attempted_at
FROM events WHERE event_type = 'error' GROUP BY 1
"""

VIEWS["feed_sources"] = """
SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, 'http://' || source || '.example.com/feed' AS url, source AS name,
 60 AS fetch_interval_minutes,
 CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 0 THEN CAST(NULL AS TIMESTAMP)
  ELSE TIMESTAMP '2024-01-30 22:00:00' + CAST(CAST(substr(source, 4) AS BIGINT) * 15 AS INT) * INTERVAL '1' MINUTE END AS last_fetched_at,
 CAST(substr(source, 4) AS BIGINT) % 5 = 0 AS is_paused FROM {D}
"""

VIEWS["event_chat_messages"] = """
SELECT conv_id * 100 + turn AS id, CAST(floor(sqrt(conv_id)) AS BIGINT) AS event_id, conv_id AS visitor_id, role, text AS content,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 60 + turn AS INT) * INTERVAL '1' MINUTE AS created_at FROM conversations
"""

VIEWS["grouping_feedback"] = f"""
SELECT event_id AS id, event_id % {_N} AS article_id,
 CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(sqrt(event_id % {_N})) AS BIGINT) END AS original_event_id,
 CASE WHEN event_id % 7 = 0 THEN 888888 ELSE CAST(floor(sqrt((event_id * 13) % {_N})) AS BIGINT) END AS corrected_event_id,
 CASE WHEN event_id % 2 = 0 THEN 'move' ELSE 'split' END AS kind,
 CASE event_id % 3 WHEN 0 THEN CAST(NULL AS {{S}}) WHEN 1 THEN '' ELSE 'note ' || CAST(event_id AS {{S}}) END AS note,
 ts AS created_at
FROM events WHERE event_type = 'purchase'
"""

VIEWS["recluster_proposals"] = f"""
SELECT event_id AS id,
 CASE event_id % 5 WHEN 0 THEN 'merge' WHEN 1 THEN 'split' WHEN 2 THEN 'cool' WHEN 3 THEN 'revive' ELSE 'new' END AS kind,
 '{{{{"event_id": ' || CAST(CAST(floor(sqrt(event_id % {_N})) AS BIGINT) AS {{S}}) || '}}}}' AS payload,
 CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL '300' DAY ELSE ts END AS created_at,
 CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS applied
FROM events WHERE event_type = 'signup'
"""

_SUMMARY_TEXT = _WORDS.format(x="c.text", G="{G}")
VIEWS["event_summaries"] = f"""
SELECT c.conv_id * 100 + c.turn AS id, CAST(floor(sqrt(c.conv_id)) AS BIGINT) AS event_id,
 CASE WHEN c.conv_id % 11 = 5 THEN CAST(NULL AS {{S}}) WHEN c.conv_id % 11 = 6 THEN '{{{{}}}}'
  ELSE '{{{{"key_developments":["k1 ' || CAST(c.conv_id AS {{S}}) || '","k2","k3","k4","k5","k6","k7"],"timeline_narrative":[{{{{"date":"2024-01-0' || CAST(c.turn % 9 + 1 AS {{S}})
   || '","text":"' || {_SUMMARY_TEXT} || '"}}}},{{{{"date":null,"text":"second"}}}},{{{{"date":"2024-01-09","text":""}}}}],'
   || '"cross_source_synthesis":{{{{"by_source":[{{{{"source":"src' || CAST(c.turn AS {{S}}) || '","observation":"' || {_SUMMARY_TEXT}
   || '"}}}},{{{{"source":null,"observation":"said so"}}}},{{{{"source":"quiet","observation":""}}}}],"synthesis":" ' || c.role || ' view "}}}},"progressive_summary":"'
   || CASE WHEN c.turn % 2 = 0 THEN ' so far ' ELSE '' END || '"}}}}' END AS summary_json,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(c.conv_id * 60 AS INT) * INTERVAL '1' MINUTE AS generated_at,
 CAST(c.turn + 1 AS INT) AS article_count
FROM conversations c
"""

# --- request and decision tables ---------------------------------------------

VIEWS["decisions"] = f"""
SELECT d.doc_id AS pos,
 CASE WHEN d.doc_id % 41 = 0 THEN -d.doc_id - 1 WHEN d.doc_id % 59 = 0 THEN d.doc_id + 1 ELSE d.doc_id END AS article_id,
 CASE WHEN d.doc_id % 37 = 5 THEN 'bogus' WHEN d.doc_id % 3 = 0 THEN 'existing' WHEN d.doc_id % 3 = 1 THEN 'new' ELSE 'uncategorized' END AS decision,
 CASE WHEN d.doc_id % 43 = 0 THEN 999999999 ELSE CAST(floor(sqrt((d.doc_id * 31) % {_N})) AS BIGINT) END AS event_id,
 CASE WHEN d.doc_id % 53 = 1 THEN '  ' WHEN d.doc_id % 4 = 0 THEN 'Solo topic ' || CAST(d.doc_id AS {{S}})
  WHEN d.doc_id % 4 = 1 THEN 'Story ' || CAST(d.doc_id % 40 AS {{S}})
  WHEN d.doc_id % 4 = 2 THEN ' TOPIC  ' || CAST(d.doc_id % 30 AS {{S}})
  ELSE 'topic ' || CAST(d.doc_id % 30 AS {{S}}) END AS event_name,
 CASE WHEN d.doc_id % 6 = 0 THEN 0.0e0 WHEN d.doc_id % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE (d.doc_id % 9) / 10.0e0 END AS importance_score,
 CASE WHEN d.doc_id % 8 = 0 THEN CAST(NULL AS DOUBLE) ELSE (d.doc_id % 11) / 10.0e0 END AS confidence
FROM {{D}} d
"""

VIEWS["merge_pairs"] = """
SELECT ((s.id * 7919) % 10007) * 10000000 + s.id AS pos,
 CASE WHEN s.id % 11 = 3 THEN 'x' ELSE '' END || CAST(s.id AS {S}) AS older_id,
 CAST(CASE WHEN s.id % 13 = 0 THEN s.id ELSE s.id + 1 END AS {S}) AS newer_id,
 CASE WHEN s.id % 7 = 0 THEN '0.69' WHEN s.id % 9 = 4 THEN CAST(NULL AS {S}) ELSE '0.7' || CAST(s.id % 3 AS {S}) END AS confidence,
 'pair ' || CAST(s.id AS {S}) AS reason FROM stories s
UNION ALL
SELECT ((s.id * 104729) % 10007) * 10000000 + 5000000 + s.id AS pos, CAST(s.id AS {S}) AS older_id, CAST(s.id + 2 AS {S}) AS newer_id,
 '0.8' AS confidence, 'skip one' AS reason FROM stories s
"""

_DOC_WORDS = _WORDS.format(x="d.text", G="{G}")
VIEWS["assignment_responses"] = f"""
SELECT r.id, CASE WHEN r.id % 19 = 7 THEN '' WHEN r.id % 7 = 3 THEN substr(r.body, 1, length(r.body) - 2)
  WHEN r.id % 11 = 4 THEN r.body || ' Hope this helps.' WHEN r.id % 23 = 8 THEN replace(r.body, '"', chr(39)) ELSE r.body END AS content
FROM (SELECT d.doc_id AS id,
 CASE d.doc_id % 5 WHEN 1 THEN '  ```json' || chr(10) WHEN 2 THEN '```' ELSE '' END
 || '{{{{"assignments":[{{{{"article_id":' || CAST(d.doc_id AS {{S}}) || CASE d.doc_id % 17 WHEN 9 THEN '.0' ELSE '' END || ',"decision":"' || CASE WHEN d.doc_id % 3 = 0 THEN 'existing' ELSE 'new' END
 || '","event_id":' || CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id % 30 AS {{S}}) ELSE 'null' END || ',"event_name":"Topic ' || CAST(d.doc_id % 9 AS {{S}})
 || '","importance_score":' || CASE d.doc_id % 4 WHEN 0 THEN '0.0' WHEN 1 THEN 'null' ELSE '0.8' END || ',"confidence":0.9,"reasoning":"' || {_DOC_WORDS}
 || '"}}}},{{{{"article_id":' || CAST(d.doc_id + 1 AS {{S}}) || ',"decision":"uncategorized"}}}}' || CASE d.doc_id % 13 WHEN 6 THEN ',"bad",7' ELSE '' END || ']}}}}'
 || CASE d.doc_id % 5 WHEN 1 THEN chr(10) || '```  ' WHEN 2 THEN '```' ELSE '' END AS body
 FROM documents d) r
"""

VIEWS["merge_responses"] = """
SELECT s.id, '{{"merge_pairs":[{{"older_id":' || CASE WHEN s.id % 6 = 0 THEN '"abc"' WHEN s.id % 6 = 1 THEN '"' || CAST(s.id AS {S}) || '"' ELSE CAST(s.id AS {S}) END
 || ',"newer_id":' || CAST(s.id + 1 AS {S}) || ',"confidence":' || CASE WHEN s.id % 4 = 0 THEN 'null' WHEN s.id % 4 = 1 THEN '"high"' ELSE '0.75' END
 || ',"reason":"same story"}}]}}' || CASE WHEN s.id % 17 = 2 THEN ' done' ELSE '' END AS content FROM stories s
"""

VIEWS["recluster_responses"] = """
SELECT s.id, '{{"merge_candidates":[{{"event_a_id":' || CAST(s.id AS {S}) || ',"event_b_id":' || CAST(s.id + 1 AS {S}) || ',"reason":"close"}}],'
 || CASE WHEN s.id % 3 = 0 THEN '' ELSE '"split_candidates":[{{"event_id":' || CAST(s.id AS {S}) || ',"suggested_new_name":"Part of ' || CAST(s.id AS {S}) || '","anchor_article_ids":[1,2]}}],' END
 || '"cooling_events":[' || CAST(s.id AS {S}) || ',' || CAST(s.id + 5 AS {S}) || CASE s.id % 7 WHEN 4 THEN ',"8",9.0,"x"' ELSE '' END || '],"reviving_events":[' || CASE WHEN s.id % 5 = 0 THEN CAST(s.id AS {S}) ELSE '' END
 || '],"new_events":[{{"name":"Fresh ' || CAST(s.id AS {S}) || '","anchor_article_ids":[' || CAST(s.id AS {S}) || ']}}]}}' || CASE s.id % 13 WHEN 5 THEN ' and so on' ELSE '' END AS content FROM stories s
"""

VIEWS["summary_responses"] = """
SELECT e.id, CASE e.id % 4 WHEN 0 THEN e.summary_json WHEN 1 THEN 'Here it is: ' || e.summary_json || ' - done' WHEN 2 THEN '```json' || chr(10) || e.summary_json || chr(10) || '```'
  ELSE substr(e.summary_json, 1, length(e.summary_json) - 1) END AS content FROM event_summaries e
"""

VIEWS["feed_entries"] = f"""
SELECT CAST(substr(d.source, 4) AS BIGINT) AS feed_id, d.doc_id AS pos, a.title,
 CASE WHEN d.doc_id % 31 = 0 THEN CAST(NULL AS {{S}})
  WHEN d.doc_id % 3 = 0 THEN 'http://src' || CAST(d.doc_id % 20 AS {{S}}) || '.example.com/' || CAST(d.doc_id % 400 AS {{S}})
  WHEN d.doc_id % 6 = 1 THEN a.url
  WHEN d.doc_id % 3 = 1 THEN 'http://' || d.source || '.example.com/n/' || CAST(d.doc_id AS {{S}})
  ELSE 'http://wire.example.com/n/' || CAST(d.doc_id % 300 AS {{S}}) END AS link,
 CASE d.doc_id % 6 WHEN 0 THEN '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS {{S}}), 2, '0') || 'T10:20:30Z'
  WHEN 1 THEN '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS {{S}}), 2, '0') || 'T11:22:33'
  WHEN 2 THEN 'Fri, ' || lpad(CAST(d.doc_id % 28 + 1 AS {{S}}), 2, '0') || ' Jan 2024 10:00:00 GMT'
  WHEN 3 THEN 'Mon, ' || CAST(d.doc_id % 28 + 1 AS {{S}}) || ' Jan 2024 12:00:00 +0000'
  WHEN 4 THEN CAST(NULL AS {{S}}) ELSE CASE WHEN d.doc_id % 12 = 5 THEN 'yesterday' ELSE '2024-01-15T00:00:00+02:00' END END AS published,
 CASE WHEN d.doc_id % 6 = 4 THEN '2024-01-16T01:00:00-01:00' ELSE CAST(NULL AS {{S}}) END AS updated,
 CASE WHEN d.doc_id % 8 = 0 THEN '<p>Detail <b>' || {_DOC_WORDS} || '</b></p>' ELSE CAST(NULL AS {{S}}) END AS summary_detail,
 CASE WHEN d.doc_id % 4 = 1 THEN '' ELSE '<div>Lead<br/><i>' || {_DOC_WORDS} || '</i> end</div>' END AS summary,
 CASE WHEN d.doc_id % 8 = 1 THEN '<p>' || {_DOC_WORDS} || '</p>' ELSE CAST(NULL AS {{S}}) END AS description,
 CASE WHEN d.doc_id % 16 = 5 THEN '<em>' || {_DOC_WORDS} || '</em>' ELSE CAST(NULL AS {{S}}) END AS content_value
FROM documents d JOIN articles a ON a.id = d.doc_id
"""

VIEWS["scrapes"] = f"""
SELECT CASE WHEN d.doc_id % 23 = 12 THEN l.link || '?moved' ELSE l.link END AS url, 'Scraped ' || CAST(d.doc_id AS {{S}}) AS title,
 CASE WHEN d.doc_id % 19 = 1 THEN CAST(NULL AS {{S}}) WHEN d.doc_id % 19 = 2 THEN 'too short to count' ELSE d.text END AS text,
 CASE WHEN d.doc_id % 13 = 3 THEN '<script>only()</script>' ELSE '<div class="c" onclick="x()"><!-- note --><p title="t">' || {_DOC_WORDS} || '</p></div>' END AS html,
 CASE WHEN d.doc_id % 17 = 0 THEN 'HTTP 503' ELSE CAST(NULL AS {{S}}) END AS error
FROM documents d JOIN (SELECT link, max(pos) AS pos FROM feed_entries WHERE link IS NOT NULL GROUP BY link) l ON l.pos = d.doc_id
"""

VIEWS["moves"] = f"""
SELECT d.doc_id AS pos, a.id AS article_id,
 CASE WHEN d.doc_id % 4 = 0 THEN CAST(NULL AS BIGINT) WHEN d.doc_id % 4 = 1 THEN a.event_id + 1 ELSE a.event_id END AS from_event_id,
 CASE WHEN d.doc_id % 10 = 6 THEN CAST(NULL AS BIGINT) WHEN d.doc_id % 47 = 0 THEN 777777 ELSE CAST(floor(sqrt((d.doc_id * 29) % {_N})) AS BIGINT) END AS to_event_id,
 CASE WHEN d.doc_id % 10 = 6 THEN ' Moved ' || CAST(d.doc_id AS {{S}}) ELSE CAST(NULL AS {{S}}) END AS new_name,
 CASE WHEN d.doc_id % 5 = 0 THEN 'editor' ELSE CAST(NULL AS {{S}}) END AS note
FROM (SELECT doc_id, (doc_id * 15) % {_N} AS target FROM {{D}}) d JOIN articles a ON a.id = d.target
"""

VIEWS["removals"] = """
SELECT a.id AS pos, CASE WHEN a.id % 3 = 0 THEN a.event_id ELSE a.event_id + 1 END AS event_id, a.id AS article_id FROM articles a
UNION ALL
SELECT a.id + 100000000 AS pos, a.event_id, a.id AS article_id FROM articles a JOIN stories s ON s.id = a.event_id AND s.status = 'archived'
"""

VIEWS["manual_merges"] = """
SELECT s.id * 3 AS pos, s.id AS primary_id, CASE WHEN s.id % 4 = 0 THEN s.id ELSE s.id + 1 END AS secondary_id,
 CASE WHEN s.id % 2 = 0 THEN CAST(NULL AS {S}) ELSE 'same' END AS note FROM stories s
"""

VIEWS["splits"] = """
SELECT s.id AS pos, s.id AS event_id, CASE WHEN s.id % 9 = 4 THEN ' ' ELSE ' Part ' || CAST(s.id AS {S}) END AS new_name, CAST(NULL AS {S}) AS note, a.id AS article_id
FROM stories s JOIN articles a ON a.event_id = s.id OR a.event_id = s.id + 1
"""

VIEWS["story_changes"] = """
SELECT s.id * 10 AS pos, 'update' AS op, s.id AS event_id, CASE WHEN s.id % 3 = 0 THEN ' Renamed ' || CAST(s.id AS {S}) ELSE CAST(NULL AS {S}) END AS name,
 CASE WHEN s.id % 4 = 0 THEN 'about it' ELSE CAST(NULL AS {S}) END AS description,
 CASE s.id % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' WHEN 2 THEN 'cooling' WHEN 3 THEN 'lost' ELSE CAST(NULL AS {S}) END AS status FROM stories s
UNION ALL
SELECT s.id * 10 + 1, CASE WHEN s.id % 8 = 5 THEN 'delete' ELSE 'update' END, CASE WHEN s.id % 16 = 7 THEN s.id + 5000000 ELSE s.id END,
 CAST(NULL AS {S}), CAST(NULL AS {S}), CASE WHEN s.id % 12 = 0 THEN 'active' ELSE 'cooling' END FROM stories s
UNION ALL
SELECT s.id * 10 + 2, 'create', CAST(NULL AS BIGINT), ' Made ' || CAST(s.id AS {S}), 'new one', CAST(NULL AS {S}) FROM stories s
"""

VIEWS["feed_changes"] = """
SELECT f.id * 10 AS pos, CASE f.id % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'unpause' WHEN 2 THEN 'interval' ELSE 'remove' END AS op,
 CASE WHEN f.id % 9 = 8 THEN f.id + 1000 ELSE f.id END AS feed_id, CAST(NULL AS {S}) AS url, CAST(NULL AS {S}) AS name,
 CASE WHEN f.id % 4 = 2 THEN 15 ELSE CAST(NULL AS INT) END AS fetch_interval_minutes FROM feed_sources f
UNION ALL
SELECT f.id * 10 + 1, 'add', CAST(NULL AS BIGINT), CASE WHEN f.id % 5 = 0 THEN 'ftp://' WHEN f.id % 5 = 1 THEN ' http://www.' ELSE 'https://' END || 'new' || CAST(f.id % 8 AS {S}) || '.example.com/rss',
 CASE WHEN f.id % 2 = 0 THEN 'Named ' || CAST(f.id AS {S}) ELSE CAST(NULL AS {S}) END, CASE WHEN f.id % 3 = 0 THEN 45 ELSE CAST(NULL AS INT) END FROM feed_sources f
"""

VIEWS["chat_turns"] = """
SELECT c.conv_id * 100 + c.turn AS pos, CAST(floor(sqrt(c.conv_id)) AS BIGINT) AS event_id, c.conv_id AS visitor_id,
 CASE WHEN c.turn % 7 = 3 THEN '  ' ELSE ' ' || c.text END AS question, CASE WHEN c.conv_id % 9 = 1 THEN '' ELSE 'Re: ' || c.text || ' ' END AS answer, c.role AS model_used
FROM conversations c
"""

VIEWS["read_requests"] = f"""
SELECT e.event_id AS pos, e.user_id AS visitor_id, (e.event_id * 3) % ({_N} + 5) AS article_id, e.ts AS at FROM events e WHERE e.event_type = 'click'
"""

VIEWS["visit_requests"] = f"""
SELECT e.event_id AS pos, e.user_id AS visitor_id, CAST(floor(sqrt((e.event_id * 3) % {_N})) AS BIGINT) + CASE WHEN e.event_id % 40 = 0 THEN 9000 ELSE 0 END AS event_id, e.ts AS at
FROM events e WHERE e.event_type = 'view'
"""

VIEWS["story_requests"] = f"""
SELECT DISTINCT e.user_id AS visitor_id, CAST(floor(sqrt((e.event_id * 7) % {_N})) AS BIGINT) AS event_id FROM events e WHERE e.event_type = 'purchase'
"""

_SPARK = {"D": "documents", "S": "STRING", "WC": r"regexp_count(d.text, r'[\p{L}\p{N}_]+')", "G": ""}
_DUCK = {"D": "documents", "S": "VARCHAR", "WC": r"len(regexp_extract_all(d.text, '[\p{L}\p{N}_]+'))", "G": ", 'g'"}


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql)]


def closure(names: list[str]) -> list[str]:
    """Views in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _needs(VIEWS[name]):
            if dep != name:
                visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _render(name: str, dialect: dict[str, str]) -> str:
    return VIEWS[name].replace("{{", "\x01").replace("}}", "\x02").format(**dialect).replace("\x01", "{").replace("\x02", "}")


def with_views(sql: str) -> str:
    """Prefix an oracle query with the CTEs of every view it names."""
    names = closure(_needs(sql))
    ctes = [f"{name} AS ({_render(name, _DUCK).strip()})" for name in names]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE "):]
    elif body.upper().startswith("WITH "):
        body = body[len("WITH "):]
    elif ctes:
        return f"WITH {', '.join(ctes)} {body}"
    else:
        return body
    return f"WITH {recursive}{', '.join([*ctes, body])}"


_LAYOUT = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table as it lies."""
    return spark.read.schema(_LAYOUT[name]).parquet(f"{sf_dir}/{name}.parquet")


def register_raw(spark: SparkSession, sf_dir: str) -> None:
    for table in RAW_TABLES:
        raw(spark, sf_dir, table).createOrReplaceTempView(table)


def view(spark: SparkSession, name: str) -> DataFrame:
    """A derived view over the registered raw tables."""
    ctes = ", ".join(f"{n} AS ({_render(n, _SPARK).strip()})" for n in closure([name]))
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")
