"""Secret scans in DataFrame functions alone.

Base kinds are patterns, each taken leftmost without overlap: a named assignment, an access key, a long
hex run.  The method adds spans: candidate strings are runs of the key alphabet; a window slides over
each, its Shannon entropy kept by incremental counts (one character comes in, one goes out, and only
their two terms of the sum change); stretches of windows above the threshold of the candidate's
character class are runs.  From a run go the places of base spans, and the segments of the candidate
(between slashes and equals signs) that the allow-list knows as harmless; what is left is a span if it has
a letter, a digit and ``LEAST`` characters.  So neither a key beside a secret nor a harmless word before it hides it.

Positions are code points, ends exclusive.  A match's place is the length of what lies before it: the
text split at the pattern gives the gaps, the pattern's matches what lies between them.

Nulls, empty and very long texts: a null text counts as empty and has no span.  Texts are scanned whole.
Repeated rows are scanned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in their listed order: pattern, and what a match must satisfy.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # as long as the run goes: the same as a run of 20 or more from AKIA on
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a window must reach, by the candidate's character class.
BITS = {"hex": 3.2, "base64": 3.8}
#: Characters that what is left of a run must have.
LEAST = 8
SEGMENT = "[^/=]+"
_WORD = "(?:[a-z]+|[A-Z][a-z]+|[A-Z]+|[0-9]{1,4})"
# What is known to be harmless, as patterns found in a segment.
ALLOWED = (
    "^[^A-Za-z]*$",  # no letter: numbers, rules and dates
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    "(?i)example|placeholder|changeme|dummy|x{6}",
    "(?i)0123456789|abcdefghij",
    f"^{_WORD}(?:[-_+]{_WORD})*$",  # words and short numbers with separators
)
MARK = "[SECRET]"

_SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(pattern: str, t: str = "t") -> str:
    """SQL for the places of a pattern in a text: structs of start, stop (code points) and hit."""
    p = _quoted(pattern)
    return f"""CASE WHEN {t} RLIKE {p} THEN aggregate(
        zip_with(slice(split({t}, {p}, -1), 1, size(regexp_extract_all({t}, {p}, 0))), regexp_extract_all({t}, {p}, 0), (g, h) -> struct(length(g) AS gap, h AS hit)),
        struct(0 AS at, CAST(array() AS array<struct<start:int,stop:int,hit:string>>) AS done),
        (a, x) -> struct(a.at + x.gap + length(x.hit) AS at,
                         concat(a.done, array(struct(a.at + x.gap AS start, a.at + x.gap + length(x.hit) AS stop, x.hit AS hit))) AS done),
        a -> a.done) ELSE CAST(array() AS array<struct<start:int,stop:int,hit:string>>) END"""


def _ranked(found: str, rank: str) -> str:
    return f"transform({found}, x -> struct(x.start AS start, {rank} AS rank, x.stop AS stop))"


def _runs(chars: str, bits: str) -> str:
    """SQL for the stretches of high-entropy windows over the characters of one candidate ``c``."""
    w = WINDOW
    term = lambda n: f"IF({n} > 1, {n} * log2({n}), 0D)"
    come, go = f"instr('{ALPHABET}', element_at(v, i))", f"IF(i > {w}, instr('{ALPHABET}', element_at(v, i - {w})), 0)"
    step = f"""(a, i) -> element_at(transform(array(struct({come} AS come, {go} AS go)), e -> struct(
            transform(a.counts, (n, k) -> n + IF(k + 1 = e.come, 1, 0) - IF(k + 1 = e.go, 1, 0)) AS counts,
            a.total + IF(e.come = e.go, 0D,
                {term('(a.counts[e.come - 1] + 1)')} - {term('a.counts[e.come - 1]')}
                + IF(e.go > 0, {term('(a.counts[greatest(e.go, 1) - 1] - 1)')} - {term('a.counts[greatest(e.go, 1) - 1]')}, 0D)) AS total,
            a.runs AS runs)), 1)"""
    note = f"""b -> IF(i >= {w} AND log2({w}D) - b.total / {w} >= {bits},
            struct(b.counts AS counts, b.total AS total,
                IF(size(b.runs) > 0 AND try_element_at(b.runs, -1).stop >= i - {w},
                   concat(slice(b.runs, 1, size(b.runs) - 1), array(struct(try_element_at(b.runs, -1).start AS start, i AS stop))),
                   concat(b.runs, array(struct(i - {w} AS start, i AS stop)))) AS runs), b)"""
    both = f"(a, i) -> element_at(transform(transform(array(a), a -> {step.split('->', 1)[1]}), {note}), 1)"
    return f"""element_at(transform(array({chars}), v -> aggregate(sequence(1, size(v)),
        struct(array_repeat(0, {len(ALPHABET)}) AS counts, 0D AS total, CAST(array() AS array<struct<start:int,stop:int>>) AS runs),
        {both}, a -> a.runs)), 1)"""


def _entropy_spans() -> str:
    """SQL for the runs over ``candidates``, as spans."""
    is_hex = "c.hit RLIKE '^[0-9A-Fa-f]+$'"
    bits = f"IF({is_hex}, {BITS['hex']}D, {BITS['base64']}D)"
    runs = _runs("regexp_extract_all(c.hit, '.', 0)", bits)
    return f"""flatten(transform(candidates, c ->
        transform({runs}, r -> struct(c.start + r.start AS start, IF({is_hex}, 3, 4) AS rank, c.start + r.stop AS stop))))"""


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the text as ``t``, and the sorted spans ``base`` and ``every``.

    A span is a struct of start, rank (place of its kind in ``KINDS``) and stop.
    """
    found = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).selectExpr(
        "*",
        _ranked(f"filter({_found(ASSIGN)}, x -> length(regexp_extract(x.hit, {_quoted(ASSIGN)}, 1)) >= 6)", "0") + " AS assign",
        _ranked(_found(ACCESS), "1") + " AS access",
        _ranked(_found(HEX), "2") + " AS hex",
        f"filter({_found(CANDIDATE)}, c -> c.hit RLIKE '[0-9]' AND c.hit RLIKE '[A-Za-z]') AS candidates",
    )
    based = found.selectExpr("* EXCEPT (assign, access, hex)", f"array_sort(CAST(concat(assign, access, hex) AS {_SPAN})) AS base")
    covered = based.selectExpr("* EXCEPT (candidates)", f"{_entropy_spans()} AS runs", f"array_sort(concat(transform(base, b -> struct(b.start AS start, b.stop AS stop)), {_harmless()})) AS cover")
    more = covered.selectExpr("* EXCEPT (runs, cover)", f"""filter(flatten(transform(runs, r -> {_left_of('r')})),
        s -> s.stop - s.start >= {LEAST} AND substr(t, s.start + 1, s.stop - s.start) RLIKE '[0-9]' AND substr(t, s.start + 1, s.stop - s.start) RLIKE '[A-Za-z]') AS added""")
    return more.selectExpr("* EXCEPT (added)", f"array_sort(CAST(concat(base, added) AS {_SPAN})) AS every")


def _harmless() -> str:
    """SQL for the places of the harmless segments of ``candidates``."""
    allowed = " OR ".join(f"s.hit RLIKE {_quoted(p)}" for p in ALLOWED)
    return f"""flatten(transform(candidates, c -> transform(filter({_found(SEGMENT, 'c.hit')}, s -> {allowed}),
        s -> struct(c.start + s.start AS start, c.start + s.stop AS stop))))"""


def _left_of(r: str) -> str:
    """SQL for the pieces of a run outside ``cover``, which is sorted."""
    piece = lambda start, stop: f"array(struct({start} AS start, {r}.rank AS rank, {stop} AS stop))"
    return f"""aggregate(filter(cover, b -> b.start < {r}.stop AND {r}.start < b.stop),
        struct({r}.start AS at, CAST(array() AS {_SPAN}) AS done),
        (a, b) -> struct(greatest(a.at, b.stop) AS at, IF(b.start > a.at, concat(a.done, {piece('a.at', 'b.start')}), a.done) AS done),
        a -> IF(a.at < {r}.stop, concat(a.done, {piece('a.at', r + '.stop')}), a.done))"""


def _joined(name: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({name}, s -> concat_ws(':', {kinds}[s.rank], s.start, s.stop)), ',')"


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each stretch of secret text replaced by a mark; ``n_chars``, where there, is counted anew."""
    rest = [c for c in docs.columns if c != "text"]
    named = docs.select(*[F.col(c).alias(f"__{n}") for n, c in enumerate(rest)], "text", F.col("text").alias("__text"))
    kept = [f"__{n}" for n in range(len(rest))]
    cut = f"""CASE WHEN size(every) = 0 THEN __text ELSE aggregate(every, struct(0 AS at, '' AS out),
        (a, s) -> struct(greatest(a.at, s.stop) AS at,
            concat(a.out, IF(s.start >= a.at, concat(substr(t, a.at + 1, s.start - a.at), '{MARK}'), '')) AS out),
        a -> concat(a.out, substr(t, a.at + 1))) END"""
    done = spans(named, [*kept, "__text"]).selectExpr(*kept, f"{cut} AS __new")
    back = {f"__{n}": c for n, c in enumerate(rest)} | {"__new": "text"}
    out = done.select(*[F.col(k).alias(c) for k, c in back.items()])
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    count = lambda rank: f"CAST(size(filter(base, s -> s.rank = {rank})) AS long)"
    return spans(docs, ["doc_id"]).selectExpr(
        "doc_id", f"{count(0)} AS n_assign", f"{count(1)} AS n_access", f"{count(2)} AS n_hex",
        f"sha2({_joined('base')}, 256) AS base_sha256", f"{_joined('every')} AS spans",
    )
