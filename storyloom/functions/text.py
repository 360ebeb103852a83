"""Text rules as column expressions (all inside the JVM)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title and body patterns per content type.
PATTERNS: dict[str, list[str]] = {
    "podcast": [
        r"^podcast[: ]",
        r"^the daily$",
        r"^today, explained$",
        r"^the .+ hour$",
        r"^political scene$",
        r"^the new yorker radio hour$",
        r"^books briefing[: ]",
        r"^culture week$",
        r"^on the news$",
        r"washington roundtable",
        r"^roundtable$",
        r"daily cartoon",
        r"^play shuffalo",
        r"^puzzles?[: ]",
        r"^the sports journalist",
        r"^jomboy on",
        r"^on .+ podcast$",
        r"listen and subscribe[: ]?",
        r"apple \| spotify \| wherever you listen",
        r"^the episode:",
    ],
    "opinion": [
        r"^opinion[: ]",
        r"^editorial[: ]",
        r"^guest essay[: ]",
        r"^op-?ed[: ]",
        r"^my .+ opinion$",
    ],
    "review": [
        r" review$",
        r"^review:",
        r" reviewed$",
        r"^a review of",
        r" rating$",
        r"^grade:",
        r"^the .+ review$",
        r"^.+ review: ",
        r"^after thorough test",
        r" review:?$",
    ],
    "advice": [
        r"^how to",
        r"^what to (watch|read|cook|buy|stream|do|see|know)",
        r"^a guide to",
        r"^best .+ of \d{4}",
        r"^the best .+ of",
        r"^\d+ best .+",
        r"^our editors recommend",
        r"^recommend(ed|ation)?[: ]",
        r"^leave your .+ open$",
        r"^why .+ won'?t solve",
        r"\d+ best .+ \(\d{4}\)",
        r"best .+ of \d{4}\)?$",
    ],
    "newsletter": [
        r"^the morning",
        r"^the evening",
        r"^newsletter[: ]",
        r"^weekly recap",
        r"^this week in",
        r"^week in review",
    ],
    "lifestyle": [
        r"^photos of the week",
        r"^fashion ",
        r"^style ",
        r"^travel ",
        r"^food ",
        r"^recipes? ",
        r"^home ",
        r"^the women who",
        r"^the whimsy",
        r"^are .+ too old\?$",
        r"^here's how .+ can",
    ],
    "cookie-banner": [
        r"this website uses essential cookies",
        r"cookies? allow us to count visits",
        r"these cookies may be set through our site by our advertising partners",
        r"we use audience measurement cookies",
        r"consent management platform",
        r"gdpr countries",
    ],
}
TITLE_ORDER = ["podcast", "opinion", "review", "advice", "newsletter", "lifestyle"]
BODY_ORDER = ["cookie-banner", "podcast", "review", "advice", "lifestyle"]
NON_EVENT_TYPES = ["podcast", "opinion", "review", "advice", "newsletter", "lifestyle", "cookie-banner"]
PROMO = r"%\s*off"
BODY_PREVIEW_CHARS = 500
SCRAPE_ERROR_PREFIX = "Scraping Error:"

# (?i) case, (?U) Unicode classes and folding, (?d) only "\n" ends a line.
_FLAGS = "(?iUd)"


def alternation(kind: str) -> str:
    """All patterns of a type as one regex."""
    return "|".join(f"(?:{p})" for p in PATTERNS[kind])


def required_literal(pattern: str) -> str:
    """Longest plain text that every match of the pattern contains."""
    gaps = re.sub(r"\\.|\[[^]]*\]|\{[^}]*\}|[^?*+][?*+]|[$^|.()]", "\0", pattern)
    return max(re.sub(r"[?*+]", "\0", gaps).split("\0"), key=len)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Spark copies an expression to every place that uses it when a filter moves
    below the projection that made it; a lambda variable is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _any_match(text: Column, folded: Column, kind: str) -> Column:
    """Does any pattern of the type match?

    Patterns bound to the start are one regex that gives up at once elsewhere.
    The others are tried only where a plain substring search in the folded
    text finds the words they need, which for most texts is nowhere.
    """
    bound = [p[1:] for p in PATTERNS[kind] if p.startswith("^")]
    free = [p for p in PATTERNS[kind] if not p.startswith("^")]
    tests = []
    if bound:
        tests.append(text.rlike(f"{_FLAGS}^(?:{'|'.join(f'(?:{p})' for p in bound)})"))
    if free:
        hints = [F.contains(folded, F.lit(word)) for word in sorted({required_literal(p) for p in free})]
        regex = text.rlike(_FLAGS + "|".join(f"(?:{p})" for p in free))
        tests.append(reduce(or_, hints) & regex)
    return reduce(or_, tests)


def _first_type(text: Column, order: list[str]) -> Column:
    """First matching type, null when none matches."""

    def decide(pair: Column) -> Column:
        whole, folded = pair["whole"], pair["folded"]
        found = F.when(_any_match(whole, folded, order[0]), F.lit(order[0]))
        for kind in order[1:]:
            found = found.when(_any_match(whole, folded, kind), F.lit(kind))
        return found

    return let(text, lambda whole: let(F.struct(whole.alias("whole"), F.lower(F.upper(whole)).alias("folded")), decide))


# Every character Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of white space from both ends, without a regex over the whole text."""
    return F.trim(c, F.lit(WHITE_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def classify_title(title: Column) -> Column:
    return F.coalesce(_first_type(strip(title), TITLE_ORDER), F.lit("news"))


def classify_article(title: Column, description: Column, text: Column, preview_chars: int | None = None) -> Column:
    """Title decides; the body, or its first ``preview_chars``, is scanned only for titles that say nothing."""
    body = text if preview_chars is None else F.left(text, F.lit(preview_chars))
    preview = F.concat_ws(" ", non_empty(description), non_empty(body))
    return F.coalesce(_first_type(strip(title), TITLE_ORDER), _first_type(preview, BODY_ORDER), F.lit("news"))


def is_non_event_type(kind: Column) -> Column:
    return kind.isin(NON_EVENT_TYPES)


def is_non_event(title: Column) -> Column:
    return is_non_event_type(classify_title(title))


def is_promo(title: Column) -> Column:
    return F.coalesce(title.rlike("(?iU)" + PROMO), F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def normalize_event_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " ")))


def snippet(text: Column, description: Column, n: int) -> Column:
    return F.left(F.coalesce(non_empty(text), non_empty(description), F.lit("")), F.lit(n))


def truncate_ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(rstrip(F.left(text, F.lit(n))), F.lit("..."))).otherwise(text)


def strip_code_fence(content: Column) -> Column:
    """Drop an opening fence (with or without ``json``) and a closing one."""
    text = strip(content)
    opened = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(text, r"^(?:```json)?(?:```)?", "")).otherwise(text)
    closed = F.when(F.endswith(opened, F.lit("```")), F.left(opened, F.length(opened) - 3)).otherwise(opened)
    return strip(closed)


def valid_visitor_id(visitor: Column) -> Column:
    return F.coalesce(visitor.rlike(r"^[0-9a-f]{32}\z"), F.lit(False))


def host_name(url: Column) -> Column:
    """Host of a feed address without ``www.``; the address itself when it has no host part."""
    host = F.try_element_at(F.split(url, "/"), F.lit(3))
    return F.coalesce(F.replace(host, F.lit("www."), F.lit("")), url)
