"""Golden rows and differential tests of the scalar rules."""

import datetime as dt
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions import answers, dates, scores, text
from storyloom.functions.html import main_content_of, plain_text_of, sanitized

# One title per pattern, in the order of the pattern table.
TITLES = {
    "podcast": [
        "Podcast: a day", "The Daily", "Today, Explained", "The Long Hour", "Political Scene", "The New Yorker Radio Hour", "Books Briefing: x",
        "Culture Week", "On the News", "With Washington Roundtable guests", "Roundtable", "A Daily Cartoon", "Play Shuffalo now", "Puzzles: one",
        "The Sports Journalist speaks", "Jomboy on it", "On Some podcast", "Please listen and subscribe: here", "Apple | Spotify | wherever you listen", "The Episode: two",
    ],
    "opinion": ["Opinion: no", "Editorial: yes", "Guest essay: hm", "Op-ed: so", "My honest opinion"],
    "review": [
        "Some film review", "Review: film", "Film reviewed", "A review of film", "Top rating", "Grade: B", "The film review", "Film review: good",
        "After thorough testing", "Camera review:",
    ],
    "advice": [
        "How to sleep", "What to watch now", "A guide to tea", "Best tea of 2024", "The best tea of all", "10 best teas", "Our editors recommend it",
        "Recommended: tea", "Leave your door open", "Why tea won't solve it", "We list 10 best teas (2024)", "Our best tea of 2024)",
    ],
    "newsletter": ["The Morning mail", "The Evening mail", "Newsletter: one", "Weekly recap", "This week in tea", "Week in review"],
    "lifestyle": [
        "Photos of the week", "Fashion now", "Style now", "Travel now", "Food now", "Recipes now", "Home now", "The women who dance", "The whimsy of it",
        "Are teas too old?", "Here's how tea can",
    ],
}
BANNERS = [
    "This website uses essential cookies", "the cookie allow us to count visits", "these cookies may be set through our site by our advertising partners",
    "we use audience measurement cookies", "consent management platform", "GDPR countries",
]
NEWS = ["", None, "Quake hits coast", "Previewing the podcast: how it went", "An opinion: none", "Best", "Reviewer speaks", "été review?"]


def values(spark, rows, column, *, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in frame.select(column(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_every_title_pattern(spark):
    rows = [(title, kind) for kind, titles in TITLES.items() for title in titles]
    assert len(rows) == sum(len(text.PATTERNS[k]) for k in TITLES) == 64
    got = values(spark, [r[0] for r in rows], text.classify_title)
    first = lambda t: next(k for k in TITLES if any(re.search(p, t, re.I) for p in text.PATTERNS[k]))
    assert got == [first(r[0]) for r in rows]
    # A title may also meet an earlier type; all others are their own type.
    assert [g for g, r in zip(got, rows) if g != r[1]] == ["review"] * [g for g, r in zip(got, rows) if g != r[1]].count("review")


def test_titles_in_other_shapes(spark):
    assert values(spark, ["  PODCAST: x  ", "\tHOW TO É\n"], text.classify_title) == ["podcast", "advice"]
    assert values(spark, NEWS, text.classify_title) == ["news"] * 3 + ["news", "news", "news", "news", "news"]


def test_body_rules(spark):
    frame = spark.createDataFrame(
        [(i, "Quake", b, "") for i, b in enumerate(BANNERS)]
        + [(6, "Quake", "", "Opinion: x"), (7, "Quake", "", "The morning"), (8, "Quake", "", "How to x"), (9, "Quake", "", "x" * 501 + " gdpr countries"), (10, "Quake", "", "travel tips\n"), (11, "Quake", "a camera review", "")],
        "i int, t string, d string, b string",
    )
    kinds = lambda *chars: [r[0] for r in frame.select(text.classify_article(F.col("t"), F.col("d"), F.col("b"), *chars), "i").orderBy("i").collect()]
    assert kinds(500) == ["cookie-banner"] * 6 + ["news", "news", "advice", "news", "lifestyle", "review"]
    assert kinds() == ["cookie-banner"] * 6 + ["news", "news", "advice", "cookie-banner", "lifestyle", "review"]


def test_required_literals_are_in_every_match():
    for kind, titles in TITLES.items():
        for pattern, title in zip(text.PATTERNS[kind], titles):
            if not pattern.startswith("^"):
                assert text.required_literal(pattern) in title.lower()


words = st.sampled_from(["the", "best", "review", "of", "2024", "how", "to", "podcast:", "opinion:", " ", "tea", "\n", "10", "(2024)", "rating", "hour", "daily", "cartoon", "K", "ſ"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(words, max_size=7).map(" ".join), min_size=20, max_size=60))
def test_classify_like_python(spark, titles):
    def plain(title):
        t = title.strip()
        for kind in text.TITLE_ORDER:
            if t and any(re.search(p, t, re.I) for p in text.PATTERNS[kind]):
                return kind
        return "news"

    assert values(spark, titles, text.classify_title) == [plain(t) for t in titles]


def test_word_count_like_python(spark):
    samples = ["Été déjà vu_2 ½", "", None, "don't stop", "日本語 text", "a-b_c  d\n"]
    assert values(spark, samples, text.word_count) == [len(re.findall(r"\b\w+\b", s or "")) for s in samples]


def test_small_text_rules(spark):
    assert values(spark, ["  A  b\tC d ", None, ""], text.normalize_event_name) == ["a b c d", "", ""]
    assert values(spark, ["abcdef", "abc   def", "ab", None], lambda c: text.truncate_ellipsis(c, 5)) == ["abcde...", "abc...", "ab", None]
    assert values(spark, ["a" * 32, "A" * 32, "a" * 31, "a" * 32 + "\n", None], text.valid_visitor_id) == [True, False, False, False, False]
    assert values(spark, ["```json\n{}\n```", "```{}```", " {} ", "```json```{}", "{}```x"], text.strip_code_fence) == ["{}", "{}", "{}", "{}", "{}```x"]
    assert values(spark, ["Save 50 % OFF", "50%off", "percent off", None], text.is_promo) == [True, True, False, False]
    assert values(spark, ["https://www.a.example/x", "plain", "http://b.example"], text.host_name) == ["a.example", "plain", "b.example"]


def test_dates(spark):
    samples = ["2024-01-05T10:20:30Z", "2024-01-05T10:20:30", "2024-01-05", "Fri, 05 Jan 2024 10:00:00 GMT", "5 Jan 2024 10:00:00 +0200", "2024-01-05 10:20:30-01:00", "junk", "2024", None, "2024-13-01"]
    got = values(spark, samples, lambda c: F.date_format(dates.normalize_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-05 10:20:30", "2024-01-05 10:20:30", "2024-01-05 00:00:00", "2024-01-05 10:00:00", "2024-01-05 08:00:00", "2024-01-05 11:20:30", None, None, None, None]
    parts = values(spark, [[2024, 1, 5, 1, 2, 3], [2024, 13, 1], [2024, 2], [2024, 2, 31], []], lambda c: F.date_format(dates.timestamp_from_parts(c), "yyyy-MM-dd HH:mm:ss"), kind="array<int>")
    assert parts == ["2024-01-05 01:02:03", None, None, None, None]


@pytest.mark.parametrize("cap, half_life", [(6.0, 8.0), (None, 8.0), (-1.0, 8.0), (2.0, 0.0)])
def test_score(spark, cap, half_life):
    now = dt.datetime(2024, 1, 31)
    rows = [(1, now - dt.timedelta(hours=8), 0.4), (1000, now, 1.5), (0, now, 0.2), (5, None, None), (3, now + dt.timedelta(hours=5), -1.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n long, t timestamp, imp double")
    got = [r[0] for r in frame.select(scores.story_score(F.col("n"), F.col("t"), F.col("imp"), F.lit(now), half_life_hours=half_life, magnitude_cap=cap), "i").orderBy("i").collect()]
    for value, (n, t, imp) in zip(got, rows):
        size = math.log2(1 + n)
        size = min(size, cap) if cap and cap > 0 else size
        fresh = 0.5 if t is None or half_life <= 0 else 0.5 ** (max(0, (now - t).total_seconds() / 3600) / half_life)
        assert value == pytest.approx(size * fresh * (0.5 + 0.5 * max(0, min(1, imp or 0))))


def test_buckets(spark):
    assert values(spark, [0.7, 0.69, 0.3, 0.29, None], scores.importance_bucket, kind="double") == ["lg", "md", "md", "sm", "sm"]


def test_exact_json(spark):
    samples = ['{"assignments":[]}', '{"assignments":[]} x', '{"assignments":[', "", "x", '{"assignments":[]},{}', None]
    got = values(spark, samples, lambda c: answers.parse_strict(c, __import__("storyloom.schemas", fromlist=["x"]).ASSIGNMENTS).isNotNull())
    assert got == [True, False, False, False, False, False, False]


def test_summary_recovery(spark):
    good = '{"timeline_narrative":[],"cross_source_synthesis":{},"progressive_summary":"a } b"}'
    samples = [f"Sure: {good} done }}", good[:-1], 'x {"a":1} y', "none", None]
    assert values(spark, samples, answers.recover_summary) == [good, None, None, None, None]


HTML = [
    ("<p>A <b>b</b> &amp; c</p>", "<p>A <b>b</b> &amp; c</p>", "A b & c"),
    ("<script>x()</script><style>y</style>hi", "x()yhi", "hi"),
    ("<!-- no --><p>open", "<p>open</p>", "open"),
    ('<a href="javascript:x()" title="t" onclick="y">z</a>', '<a title="t">z</a>', "z"),
    ('<a href="https://e.example/?a=1&amp;b=2">z</a>', '<a href="https://e.example/?a=1&amp;b=2">z</a>', "z"),
    ('<a href=" JaVa\tscript:x">z</a><img src="/a.png" alt="i">', '<a>z</a><img src="/a.png" alt="i">', "z"),
    ("<div><p class='c' style='s'>x</p></div>", '<p class="c">x</p>', "x"),
    ("1 < 2 &lt;b&gt;", "1 &lt; 2 &lt;b&gt;", "1 < 2 <b>"),
]


@pytest.mark.parametrize("html, clean, plain", HTML)
def test_html(html, clean, plain):
    assert sanitized(html) == clean
    assert plain_text_of(html) == plain


def test_main_content():
    page = "<html><head><title> A  page </title><script>no()</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One   two</p><p>Three</p></article><footer>end</footer></body></html>"
    assert main_content_of(page) == ("A page", "Head\nOne two\nThree")
    assert main_content_of("<p>only <b>this</b></p>") == (None, "only this")


def test_main_content_of_broken_and_plain_pages():
    from storyloom.functions.html import main_content_of

    assert main_content_of("<html><title>T</title><body><form><p>Real story.</p></body></html>") == ("T", "Real story.")
    assert main_content_of("<body><div><nav><a>Home</a></div><article><p>Real</p><p>story.</p></article></body>")[1] == "Real\nstory."
    assert main_content_of("<nav>menu<article><p>Real</p></article>")[1] == "Real"
    menu = "<div><a>Home</a><a>Login</a></div><div class='x'><p>Real story text.</p><p>More of it.</p></div><div><p>ad</p></div>"
    assert main_content_of(menu)[1] == "Real story text.\nMore of it."
    assert main_content_of("just text")[1] == "just text"
    assert main_content_of("")[1] == ""


def test_main_content_of_cut_references():
    page = "<title>You &amp;&amp and&amp</title><article><h1>and&amp</h1><p>a &lt b &lt;i&gt; &amp;lt; &ampx; &#65; &quot;&copy 1&quot;</p></article>"
    assert main_content_of(page) == ("You &&amp and&amp", 'and&amp\na &lt b <i> &lt; &ampx; A "&copy 1"')
