"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

from storyloom.llm import importance, neighbours, prefix_trie, secret_scan

_WORDS = r"SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"


def _windows(size: int) -> str:
    """Rows of doc_id, start and content of every window of so many words."""
    return f"SELECT doc_id, s, md5(array_to_string(w[s:s + {size - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS s FROM d WHERE len(w) >= {size}) x"


SUBSTRINGS = f"""
WITH d AS ({_WORDS}), g AS ({_windows(50)}), lo AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM g JOIN lo USING (h) WHERE least < doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

RULES = f"""
WITH d AS ({_WORDS}), g AS ({_windows(5)}), often AS (SELECT doc_id, h FROM g GROUP BY doc_id, h HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS i FROM g JOIN often USING (doc_id, h)) x GROUP BY doc_id),
counted AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(t) - len(regexp_extract_all(t, '[\\x20\\x09-\\x0D]')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stuttered FROM d LEFT JOIN inside ON inside.doc_id = d.doc_id),
judged AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 3 * len(lines) OR 10 * capitals > 4 * n_words OR 10 * stuttered > 2 * n_words
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM judged
"""



def _places(pattern: str, where: str = "true") -> str:
    """Rows of doc_id, start, stop and hit of a pattern: what lies before a match is the gaps and matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    lengths = lambda items: f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop, hit FROM (
      SELECT doc_id, {lengths('gaps[1:i]')} + {lengths('hits[1:i - 1]')} AS start, hits[i] AS hit FROM (
        SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits FROM d) a) b) c WHERE {where}"""


_ASSIGN = "'" + secret_scan.ASSIGN.replace("'", "''") + "'"
_HARMLESS = " OR ".join("regexp_matches(hit, '" + p + "')" for p in secret_scan.ALLOWED)
_LETTER_AND_DIGIT = "regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[A-Za-z]')"
_W = secret_scan.WINDOW
_IS_HEX = "regexp_full_match(hit, '[0-9A-Fa-f]+')"

#: Every window's entropy is counted anew here.
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, start, stop, 0 AS rank, 'assign' AS kind FROM ({_places(secret_scan.ASSIGN, f'length(regexp_extract(hit, {_ASSIGN}, 1)) >= 6')}) x
  UNION ALL SELECT doc_id, start, stop, 1, 'access' FROM ({_places(secret_scan.ACCESS)}) x
  UNION ALL SELECT doc_id, start, stop, 2, 'hex' FROM ({_places(secret_scan.HEX)}) x),
candidates AS (SELECT * FROM ({_places(secret_scan.CANDIDATE)}) x WHERE {_LETTER_AND_DIGIT.format('hit')}),
windows AS (SELECT doc_id, start, hit, k FROM (SELECT doc_id, start, hit, unnest(range(0, length(hit) - {_W - 1})) AS k FROM candidates) x
  WHERE list_aggregate(string_split(substr(hit, k + 1, {_W}), ''), 'entropy') >= CASE WHEN {_IS_HEX} THEN {secret_scan.BITS['hex']} ELSE {secret_scan.BITS['base64']} END),
marked AS (SELECT *, CASE WHEN k > {_W} + lag(k) OVER (PARTITION BY doc_id, start ORDER BY k) THEN 1 ELSE 0 END AS opens FROM windows),
runs AS (SELECT doc_id, start + min(k) AS start, start + max(k) + {_W} AS stop, {_IS_HEX} AS is_hex FROM
  (SELECT *, sum(opens) OVER (PARTITION BY doc_id, start ORDER BY k) AS run FROM marked) x GROUP BY doc_id, start, hit, run),
segments AS (SELECT doc_id, start + coalesce(list_sum(list_transform(segs[:i - 1], lambda x: length(x) + 1)), 0) AS start, segs[i] AS hit
  FROM (SELECT doc_id, start, segs, unnest(range(1, len(segs) + 1)) AS i FROM (SELECT doc_id, start, string_split(replace(hit, '=', '/'), '/') AS segs FROM candidates) x) y),
cover AS (SELECT doc_id, start, stop FROM base UNION ALL SELECT doc_id, start, start + length(hit) FROM segments WHERE length(hit) > 0 AND ({_HARMLESS})),
free AS (SELECT r.doc_id, r.start, is_hex, p FROM (SELECT doc_id, start, is_hex, unnest(range(start, stop)) AS p FROM runs) r
  WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.doc_id = r.doc_id AND c.start <= p AND p < c.stop)),
pieces AS (SELECT doc_id, is_hex, min(p) AS start, max(p) + 1 AS stop FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, start ORDER BY p) AS island FROM free) x GROUP BY doc_id, start, is_hex, island),
added AS (SELECT p.doc_id, start, stop, CASE WHEN is_hex THEN 3 ELSE 4 END AS rank, CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind
  FROM pieces p JOIN d ON d.doc_id = p.doc_id WHERE stop - start >= {secret_scan.LEAST} AND {_LETTER_AND_DIGIT.format('substr(t, start + 1, stop - start)')}),
own AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN every ON every.doc_id = d.doc_id
"""

ORACLES = {
    "op1_secret_scan": SECRETS, "op2_nearest_neighbours": neighbours.ORACLE, "op5_substring_dedup": SUBSTRINGS, "op8_quality_rules": RULES,
    "op11_importance_resampling": importance.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
