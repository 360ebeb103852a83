"""Scalar rules, ingest gates and feed verdicts."""

from pyspark.sql import functions as F

from storyloom.catalog.registry import NOW, query
from storyloom.functions import dates, html, text
from storyloom.operators import ingest, verdicts
from storyloom.session import shared_dir
from storyloom.sources import feeds as feed_source
from storyloom.sources import tables

# --- oracle building blocks --------------------------------------------------


def _match(expr: str, kind: str) -> str:
    return f"""regexp_matches({expr}, '(?i){text.alternation(kind).replace("'", "''")}')"""


def _cases(expr: str, order: list[str]) -> str:
    return " ".join(f"WHEN {_match(expr, kind)} THEN '{kind}'" for kind in order)


def _strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def title_type(expr: str) -> str:
    return f"CASE {_cases(_strip(expr), text.TITLE_ORDER)} ELSE 'news' END"


def article_type(title: str, description: str, body: str, chars: int | None = None) -> str:
    seen = body if chars is None else f"left({body}, {chars})"
    preview = f"regexp_replace(concat_ws(' ', nullif({description}, ''), nullif({seen}, '')), '\\n$', '')"
    return f"coalesce(CASE {_cases(_strip(title), text.TITLE_ORDER)} END, CASE {_cases(preview, text.BODY_ORDER)} END, 'news')"


def words(expr: str) -> str:
    return rf"coalesce(len(regexp_extract_all({expr}, '[\p{{L}}\p{{N}}_]+')), 0)"


NON_EVENT = "('podcast', 'opinion', 'review', 'advice', 'newsletter', 'lifestyle', 'cookie-banner')"


def feed_date(expr: str) -> str:
    offset = rf"regexp_extract({expr}, '([+-]\d\d):\d\d$', 1)"
    return (
        rf"coalesce(try_cast(left({expr}, 19) AS TIMESTAMP) - coalesce(try_cast({offset} AS INTEGER), 0) * INTERVAL '1' HOUR, "
        f"try_strptime(substr({expr}, 6), '%d %b %Y %H:%M:%S GMT'), try_strptime(substr({expr}, 6), '%d %b %Y %H:%M:%S +0000'))"
    )


def plain(expr: str) -> str:
    return f"array_to_string([trim(x) for x in string_split_regex({expr}, '<[^>]*>') if trim(x) <> ''], ' ')"


RAW_DESCRIPTION = "coalesce(nullif(summary_detail, ''), nullif(summary, ''), nullif(description, ''), nullif(content_value, ''))"

# --- scalar rules ------------------------------------------------------------


@query("classify_title", f"SELECT id, {title_type('title')} AS content_type FROM articles")
def _(t):
    return t.articles.select("id", text.classify_title(F.col("title")).alias("content_type"))


@query("classify_article_preview", f"SELECT id, {article_type('title', 'rss_description', 'scraped_text_content', text.BODY_PREVIEW_CHARS)} AS content_type FROM articles")
def _(t):
    kind = text.classify_article(F.col("title"), F.col("rss_description"), F.col("scraped_text_content"), text.BODY_PREVIEW_CHARS)
    return t.articles.select("id", kind.alias("content_type"))


@query("classify_article", f"SELECT id, {article_type('title', 'rss_description', 'scraped_text_content')} AS content_type FROM articles")
def _(t):
    kind = text.classify_article(F.col("title"), F.col("rss_description"), F.col("scraped_text_content"))
    return t.articles.select("id", kind.alias("content_type"))


@query("is_non_event", f"SELECT id, {title_type('title')} IN {NON_EVENT} AS non_event FROM articles")
def _(t):
    return t.articles.select("id", text.is_non_event(F.col("title")).alias("non_event"))


@query("normalize_event_name", r"SELECT id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS normalized FROM stories")
def _(t):
    return t.stories.select("id", text.normalize_event_name(F.col("name")).alias("normalized"))


@query("word_count", f"SELECT doc_id, {words('text')} AS words FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("snippet", "SELECT id, left(coalesce(nullif(scraped_text_content, ''), nullif(rss_description, ''), ''), 500) AS live, left(coalesce(nullif(scraped_text_content, ''), nullif(rss_description, ''), ''), 300) AS recluster FROM articles")
def _(t):
    cut = lambda n: text.snippet(F.col("scraped_text_content"), F.col("rss_description"), n)
    return t.articles.select("id", cut(500).alias("live"), cut(300).alias("recluster"))


@query("truncate_ellipsis", r"SELECT doc_id, CASE WHEN length(text) > 3000 THEN regexp_replace(left(text, 3000), '\s+$', '') || '...' ELSE text END AS cut FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.truncate_ellipsis(F.col("text"), 3000).alias("cut"))


@query("valid_visitor_id", "SELECT doc_id, regexp_matches(key, '^[0-9a-f]{32}$') AS valid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN upper(md5(text)) ELSE md5(text) || '0' END AS key FROM documents) x")
def _(t):
    digest = F.md5("text")
    key = F.when(F.col("doc_id") % 3 == 0, digest).when(F.col("doc_id") % 3 == 1, F.upper(digest)).otherwise(F.concat(digest, F.lit("0")))
    return t.raw("documents").select("doc_id", text.valid_visitor_id(key).alias("valid"))


@query("strip_code_fence", f"""
SELECT id, {_strip("regexp_replace(regexp_replace(regexp_replace(" + _strip('content') + ", '^```json', ''), '^```', ''), '```$', '')")} AS content FROM assignment_responses""")
def _(t):
    return t.assignment_responses.select("id", text.strip_code_fence(F.col("content")).alias("content"))


@query("normalize_timestamp", f"SELECT pos, {feed_date('coalesce(published, updated)')} AS published_date, coalesce({feed_date('published')}, {feed_date('updated')}) AS verdict_date FROM feed_entries")
def _(t):
    entries = t.feed_entries
    return entries.select(
        "pos", ingest.entry_date(entries).alias("published_date"), dates.verdict_date(F.col("published"), F.col("updated")).alias("verdict_date")
    )


@query("html_to_text", f"SELECT pos, {plain(RAW_DESCRIPTION)} AS description FROM feed_entries")
def _(t):
    entries = t.feed_entries
    return entries.select("pos", html.html_to_text(ingest.pick_description(entries)).alias("description"))


@query("pick_description", f"SELECT pos, {RAW_DESCRIPTION} AS raw FROM feed_entries")
def _(t):
    entries = t.feed_entries
    return entries.select("pos", ingest.pick_description(entries).alias("raw"))


@query("sanitize_html", r"""
SELECT url, CASE WHEN html LIKE '<script>%' THEN 'only()' ELSE regexp_replace(replace(html, '<div class="c" onclick="x()"><!-- note --><p title="t">', '<p>'), '</div>$', '') END AS html FROM scrapes""")
def _(t):
    return t.scrapes.select("url", html.sanitize_html(F.col("html")).alias("html"))


@query("sanitize_pages")
def _(t):
    return t.raw("pages").select("page_id", F.length(html.sanitize_html(F.col("html"))).alias("html_chars"))


# --- sources -----------------------------------------------------------------


@query("load_tables", "SELECT id, name, status, created_at, last_article_at, archived_at, expires_at, CAST(NULL AS VARCHAR) AS description FROM stories")
def _(t):
    base = tables.run_dir(shared_dir(t.spark), "store")
    tables.write_snapshot(t.stories.limit(0), base, "stories")
    tables.write_snapshot(t.stories, base, "stories")
    loaded = tables.load_tables(t.spark, base, ["stories"])["stories"]
    return loaded.select("id", "name", "status", "created_at", "last_article_at", "archived_at", "expires_at", "description")


@query("write_snapshot", "SELECT id, feed_source_id, title, event_id, word_count, scraped_text_content FROM articles")
def _(t):
    base = tables.run_dir(shared_dir(t.spark), "store")
    tables.write_snapshot(t.articles, base, "articles", files_by=["event_id"])
    loaded = tables.load_tables(t.spark, base, ["articles"])["articles"]
    return loaded.select("id", "feed_source_id", "title", "event_id", "word_count", "scraped_text_content")


@query("append_articles", "SELECT id, url, title FROM articles")
def _(t):
    path = tables.run_dir(shared_dir(t.spark), "articles")
    tables.append_articles(t.articles.filter(F.col("event_id").isNull()), path)
    tables.append_articles(t.articles.filter(F.col("event_id").isNotNull()), path)
    return t.spark.read.parquet(path).select("id", "url", "title")


@query("read_feed_entries", """SELECT feed_id, trim(title) AS title, link, published, updated, CASE WHEN feed_id % 2 = 0 THEN trim(description) END AS description,
 CASE WHEN feed_id % 2 = 1 THEN trim(description) END AS content FROM feed_entries""")
def _(t):
    """Feeds of even number land as RSS, the others as Atom with the description as content."""
    path = tables.run_dir(shared_dir(t.spark), "landing")
    entries = t.feed_entries.select("feed_id", "title", "link", "published", "updated", "description")
    feed_source.land_feed_documents(entries.filter("feed_id % 2 = 0"), path)
    feed_source.land_feed_documents(entries.filter("feed_id % 2 = 1").withColumnRenamed("description", "content"), path, atom=True)
    read = feed_source.read_feed_entries(t.spark, path)
    return read.select("feed_id", F.trim("title").alias("title"), "link", "published", "updated", F.trim("description").alias("description"), F.trim("content_value").alias("content"))


@query("stream_feed_entries", "SELECT feed_id, link, published FROM feed_entries")
def _(t):
    from storyloom.streaming.streams import run_into_files

    path = tables.run_dir(shared_dir(t.spark), "landing")
    feed_source.land_feed_documents(t.feed_entries, path)
    return run_into_files(feed_source.stream_feed_entries(t.spark, path).select("feed_id", "link", "published"), "entries")


@query("evolve_schema", """
SELECT id, coalesce(last_article_at, created_at) + INTERVAL '48' HOUR AS expires_at, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS INTEGER) AS summary_version FROM stories""")
def _(t):
    from storyloom import schemas

    old = t.stories.drop("expires_at")
    return tables.evolve_schema(old, schemas.STORIES).select("id", "expires_at", "description", "summary_version")


@query("seed_feeds", r"""
SELECT u.url, replace(split_part(u.url, '/', 3), 'www.', '') AS name, 30 AS fetch_interval_minutes FROM (SELECT DISTINCT url FROM pages) u
WHERE NOT EXISTS (SELECT 1 FROM feed_sources f WHERE f.url = u.url)""")
def _(t):
    seeded = feed_source.seed_feeds(t.feed_sources, t.raw("pages").select("url"), NOW)
    return seeded.join(t.feed_sources.select("url"), "url", "left_anti").select("url", "name", "fetch_interval_minutes")


# --- gates -------------------------------------------------------------------

_LINKED = "link IS NOT NULL AND link <> ''"


@query("feeds_due", "SELECT id FROM feed_sources WHERE last_fetched_at IS NULL OR last_fetched_at < {NOW} - fetch_interval_minutes * INTERVAL '1' MINUTE")
def _(t):
    return ingest.feeds_due(t.feed_sources, NOW).select("id")


@query("feeds_due_unpaused", "SELECT id FROM feed_sources WHERE (last_fetched_at IS NULL OR last_fetched_at < {NOW} - fetch_interval_minutes * INTERVAL '1' MINUTE) AND NOT is_paused")
def _(t):
    return ingest.feeds_due(t.feed_sources, NOW, exclude_paused=True).select("id")


@query("cap_per_feed", f"SELECT feed_id, pos FROM feed_entries WHERE {_LINKED} QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY pos) <= 15")
def _(t):
    return ingest.cap_per_feed(t.feed_entries.filter(ingest.has_link(F.col("link")))).select("feed_id", "pos")


@query("skip_recent_failures", "SELECT pos, link FROM feed_entries e WHERE NOT EXISTS (SELECT 1 FROM scrape_failures f WHERE f.url = e.link AND f.last_attempted_at > {NOW} - INTERVAL '7' DAY)")
def _(t):
    return ingest.skip_recent_failures(t.feed_entries, t.scrape_failures, NOW).select("pos", "link")


@query("skip_existing_urls", "SELECT pos, link FROM feed_entries e WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.url = e.link)")
def _(t):
    return ingest.skip_existing_urls(t.feed_entries, t.articles).select("pos", "link")


@query("require_title_date", f"SELECT pos FROM feed_entries WHERE title <> '' AND {feed_date('coalesce(published, updated)')} IS NOT NULL")
def _(t):
    return ingest.require_title_date(t.feed_entries).select("pos")


@query("drop_promo_titles", r"SELECT pos FROM feed_entries WHERE NOT coalesce(regexp_matches(title, '(?i)%\s*off'), false)")
def _(t):
    return ingest.drop_promo_titles(t.feed_entries).select("pos")


@query("purge_percent_off", r"SELECT id FROM articles WHERE NOT coalesce(regexp_matches(title, '(?i)%\s*off'), false)")
def _(t):
    return ingest.drop_promo_titles(t.articles).select("id")


@query("dedup_batch_urls", f"SELECT link, max(pos) AS pos FROM feed_entries WHERE {_LINKED} GROUP BY link")
def _(t):
    return ingest.dedup_batch_urls(t.feed_entries.filter(ingest.has_link(F.col("link")))).select("link", "pos")


_WC = words("text")
_ERROR = f"""nullif(concat_ws(' | ', nullif(error, ''), CASE WHEN coalesce(text, '') = '' OR {_WC} < 50
 THEN 'extracted text too short (<50 words) or empty: ' || CAST({_WC} AS VARCHAR) || ' words' END), '')"""


_PAGE = r"""
cut AS (SELECT url, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')) AS title, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
flat AS (SELECT url, title, replace(replace(replace(replace(regexp_replace(regexp_replace(body, '</?(p|div|section|li|ul|ol|h[1-6]|br|tr|table|blockquote|pre)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS body FROM cut),
page AS (SELECT url, replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, regexp_replace(regexp_replace(regexp_replace(body, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '[ \t]{2,}', ' ', 'g') AS text, CAST(NULL AS VARCHAR) AS error FROM flat)"""


@query("extract_main_content", f"WITH {_PAGE} SELECT url, title, text, {_WC} AS word_count, {_ERROR} AS scrape_error FROM page")
def _(t):
    return ingest.read_pages(t.raw("pages")).select("url", "title", "text", "word_count", "scrape_error")


@query("scrape_error_gate", f"SELECT url, {_WC} AS word_count, {_ERROR} AS scrape_error FROM scrapes")
def _(t):
    return ingest.scrape_error_gate(t.scrapes).select("url", "word_count", "scrape_error")


@query("min_word_gate", "SELECT id FROM articles WHERE word_count >= 350")
def _(t):
    return ingest.min_word_gate(t.articles).select("id")


@query("non_event_gate", f"SELECT id FROM articles WHERE {article_type('title', 'rss_description', 'scraped_text_content')} NOT IN {NON_EVENT}")
def _(t):
    return ingest.non_event_gate(t.articles).select("id")


@query("cleanup_bad", f"""
SELECT id FROM articles WHERE NOT starts_with(scraped_text_content, 'Scraping Error:') AND word_count >= 350
 AND {article_type('title', 'rss_description', 'scraped_text_content')} NOT IN {NON_EVENT}""")
def _(t):
    return ingest.cleanup_bad(t.articles).select("id")


@query("record_scrape_failures", f"""
WITH bad AS (SELECT url, {_ERROR} AS error FROM scrapes WHERE {_ERROR} IS NOT NULL)
SELECT coalesce(f.url, b.url) AS url, coalesce(b.error, f.error) AS error, coalesce(f.attempt_count, 0) + CASE WHEN b.url IS NULL THEN 0 ELSE 1 END AS attempt_count,
 coalesce(f.first_attempted_at, {{NOW}}) AS first_attempted_at, CASE WHEN b.url IS NULL THEN f.last_attempted_at ELSE {{NOW}} END AS last_attempted_at
FROM scrape_failures f FULL JOIN bad b ON b.url = f.url""")
def _(t):
    bad = ingest.scrape_error_gate(t.scrapes).filter(F.col("scrape_error").isNotNull()).select("url", F.col("scrape_error").alias("error"))
    return ingest.record_scrape_failures(t.scrape_failures, bad, NOW)


@query("join_entries_to_scrapes", """
SELECT e.pos, e.link, coalesce(nullif(e.title, ''), s.title) AS title, f.name AS publisher_name, s.text FROM feed_entries e JOIN scrapes s ON s.url = e.link LEFT JOIN feed_sources f ON f.id = e.feed_id""")
def _(t):
    return ingest.join_entries_to_scrapes(t.feed_entries, t.scrapes, t.feed_sources).select("pos", "link", "title", "publisher_name", "text")


_GATES = f"""
failed AS (SELECT url FROM scrape_failures WHERE last_attempted_at > {{NOW}} - INTERVAL '7' DAY),
cutoffs AS (SELECT feed_id, pos AS cutoff FROM feed_entries WHERE {_LINKED} AND link NOT IN (SELECT url FROM failed) QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY pos) = 15),
first_gates AS (SELECT e.*, {feed_date('coalesce(published, updated)')} AS published_date,
 CASE WHEN e.pos > c.cutoff THEN 'over_cap' WHEN link IS NULL OR link = '' THEN 'no_link' WHEN link IN (SELECT url FROM failed) THEN 'recent_failure'
  WHEN link IN (SELECT url FROM articles) THEN 'stored' WHEN coalesce(title, '') = '' THEN 'no_title' WHEN {feed_date('coalesce(published, updated)')} IS NULL THEN 'no_date'
  WHEN regexp_matches(title, '(?i)%\\s*off') THEN 'promo' END AS gate FROM feed_entries e LEFT JOIN cutoffs c ON c.feed_id = e.feed_id),
gated AS (SELECT * REPLACE (CASE WHEN gate IS NULL AND pos < max(CASE WHEN gate IS NULL THEN pos END) OVER (PARTITION BY link) THEN 'duplicate' ELSE gate END AS gate) FROM first_gates),
described AS (SELECT g.*, s.url AS scraped_url, s.text, {words('s.text')} AS word_count, {_ERROR} AS scrape_error, {plain(RAW_DESCRIPTION)} AS rss_description
 FROM gated g LEFT JOIN scrapes s ON s.url = g.link),
final AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN scraped_url IS NULL THEN 'not_scraped' WHEN scrape_error IS NOT NULL THEN 'scrape_error' WHEN word_count < 350 THEN 'too_short'
 WHEN {article_type('title', 'rss_description', 'text')} IN {NON_EVENT} THEN 'non_event' ELSE 'stored_now' END AS result FROM described)"""


def _run(t):
    return ingest.ingest_articles(t.feed_sources, t.feed_entries, t.scrapes, t.articles, t.scrape_failures, NOW)


@query("ingest_gate_log", f"WITH {_GATES} SELECT feed_id, pos, result AS gate FROM final")
def _(t):
    return _run(t).log


@query("ingest_gate_counts", f"WITH {_GATES} SELECT result AS gate, count(*) AS n FROM final GROUP BY result")
def _(t):
    return _run(t).gate_counts


@query("ingest_articles", f"""WITH {_GATES}
SELECT f.feed_id AS feed_source_id, f.link AS url, f.title, s.name AS publisher_name, f.published_date, f.rss_description, f.text AS scraped_text_content, f.word_count, {{NOW}} AS fetched_at
FROM final f LEFT JOIN feed_sources s ON s.id = f.feed_id WHERE f.result = 'stored_now'""")
def _(t):
    return _run(t).articles.drop("full_html_content")


@query("ingest_failures", f"""WITH {_GATES}, bad AS (SELECT link AS url, scrape_error AS error FROM final WHERE result = 'scrape_error')
SELECT coalesce(f.url, b.url) AS url, coalesce(b.error, f.error) AS error, coalesce(f.attempt_count, 0) + CASE WHEN b.url IS NULL THEN 0 ELSE 1 END AS attempt_count,
 coalesce(f.first_attempted_at, {{NOW}}) AS first_attempted_at, CASE WHEN b.url IS NULL THEN f.last_attempted_at ELSE {{NOW}} END AS last_attempted_at
FROM scrape_failures f FULL JOIN bad b ON b.url = f.url""")
def _(t):
    return _run(t).failures


@query("ingest_feeds", "SELECT f.id, CASE WHEN EXISTS (SELECT 1 FROM feed_entries e WHERE e.feed_id = f.id) THEN {NOW} ELSE f.last_fetched_at END AS last_fetched_at FROM feed_sources f")
def _(t):
    return _run(t).feeds.select("id", "last_fetched_at")


# --- verdicts ----------------------------------------------------------------

_VALID = f"{_LINKED} AND coalesce({feed_date('published')}, {feed_date('updated')}) IS NOT NULL"
_CHECKS = f"""
sampled AS (SELECT *, coalesce({feed_date('published')}, {feed_date('updated')}) AS published_date FROM feed_entries WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY pos) <= 5),
described AS (SELECT p.*, s.url AS scraped_url, coalesce(s.text, '') AS text, nullif(s.error, '') AS error, {plain(RAW_DESCRIPTION)} AS rss_description FROM sampled p LEFT JOIN scrapes s ON s.url = p.link),
checks AS (SELECT *, {words('text')} AS scraped_words, {article_type('title', 'rss_description', 'text')} AS content_type FROM described),
judged AS (SELECT *, coalesce(title, '') <> '' AND error IS NULL AND scraped_words >= 350 AND content_type NOT IN {NON_EVENT} AS all_gates FROM checks)"""


@query("sample_entries", f"SELECT feed_id, pos, link FROM feed_entries WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY pos) <= 5")
def _(t):
    return verdicts.sample_entries(t.feed_entries).select("feed_id", "pos", "link")


@query("passes_all_gates", f"""WITH {_CHECKS}
SELECT feed_id, pos, scraped_words, length(coalesce(rss_description, '')) AS description_chars, content_type, error AS scraper_error, all_gates,
 array_to_string([x for x in [CASE WHEN rss_description <> '' THEN NULL ELSE 'rss_description_missing' END, CASE WHEN coalesce(title, '') <> '' THEN NULL ELSE 'title_missing' END,
  CASE WHEN scraped_url IS NOT NULL AND error IS NOT NULL THEN 'scraper_error:' || left(error, 80) END,
  CASE WHEN scraped_url IS NOT NULL AND error IS NULL AND scraped_words < 350 THEN 'text_too_short:' || CAST(scraped_words AS VARCHAR) || 'w<350w' END,
  CASE WHEN scraped_url IS NULL THEN 'no_scraped_doc' END, CASE WHEN content_type IN {NON_EVENT} THEN 'non_event_type:' || content_type END] if x IS NOT NULL], ';') AS fails FROM judged""")
def _(t):
    checks = verdicts.check_entries(verdicts.sample_entries(t.feed_entries), t.scrapes)
    return checks.select("feed_id", "pos", "scraped_words", "description_chars", "content_type", "scraper_error", "all_gates", F.array_join("fails", ";").alias("fails"))


_VERDICT = f"""{_CHECKS},
marked AS (SELECT feed_id, pos, {_LINKED} AS has_link, coalesce({feed_date('published')}, {feed_date('updated')}) IS NOT NULL AS has_date FROM feed_entries),
stops AS (SELECT feed_id, max(pos) AS stop FROM sampled GROUP BY feed_id HAVING count(*) = 5),
seen AS (SELECT m.feed_id, count(*) AS entries_seen, count(*) FILTER (WHERE (s.stop IS NULL OR m.pos <= s.stop) AND m.has_link) AS entries_with_link,
 count(*) FILTER (WHERE (s.stop IS NULL OR m.pos <= s.stop) AND m.has_date) AS entries_with_date FROM marked m LEFT JOIN stops s ON s.feed_id = m.feed_id GROUP BY m.feed_id),
per_feed AS (SELECT feed_id, count(*) AS sampled, count(*) FILTER (WHERE scraped_url IS NOT NULL AND error IS NULL) AS entries_scraped,
 count(*) FILTER (WHERE error IS NULL AND scraped_words >= 350) AS entries_full_text, count(*) FILTER (WHERE all_gates) AS entries_all_gates FROM judged GROUP BY feed_id),
verdict AS (SELECT n.feed_id, n.entries_seen, n.entries_with_link, n.entries_with_date, coalesce(sampled, 0) AS sampled, coalesce(entries_scraped, 0) AS entries_scraped,
 coalesce(entries_full_text, 0) AS entries_full_text, coalesce(entries_all_gates, 0) AS entries_all_gates,
 round(100.0e0 * coalesce(entries_full_text, 0) / greatest(1, coalesce(sampled, 0)), 6) AS pct_full_text, round(100.0e0 * coalesce(entries_all_gates, 0) / greatest(1, coalesce(sampled, 0)), 6) AS pct_all_gates,
 coalesce(sampled, 0) > 0 AND coalesce(entries_all_gates, 0) >= greatest(1, coalesce(sampled, 0) // 2) AS overall_pass
FROM seen n LEFT JOIN per_feed p ON p.feed_id = n.feed_id)"""


@query("feed_verdict", f"WITH {_VERDICT} SELECT * FROM verdict")
def _(t):
    return verdicts.feed_verdict(t.feed_entries, t.scrapes)


@query("export_verdicts", f"WITH {_VERDICT} SELECT feed_id, entries_seen, sampled, overall_pass FROM verdict")
def _(t):
    path = tables.run_dir(shared_dir(t.spark), "verdicts")
    tables.export_verdicts(verdicts.feed_verdict(t.feed_entries, t.scrapes), path)
    return t.spark.read.schema("feed_id long, entries_seen long, sampled long, overall_pass boolean").json(path)

