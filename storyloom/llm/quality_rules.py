"""Quality rules as a short-circuit cascade.

Every rule looks at one text and says whether it rejects it.  Each task judges its first
``sample_docs`` documents by all rules, one after another and each on a fresh view, and so learns what
a rule costs and how many documents it rejects.  From then on it applies the rules in the order of
rejections per cost and stops at the first that rejects.  The verdict is that of all rules together, so
the order changes the cost of a document but never its verdict: a task that runs again after a lost
executor may choose another order and still returns the same rows.

Nulls, empty and very long texts: a null text counts as an empty one; both have no words and are
rejected.  Texts are judged whole.  Repeated rows are judged one by one, an empty table gives an empty
result, and other columns of the table are neither read nor in the way.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import ASCII_SPACE, mapped_texts, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


class View:
    """A text and what rules ask of it, worked out when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(ASCII_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_capital_words(self) -> int:
        """Words whose ASCII letters, at least one, are all capitals."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_stuttered(self) -> int:
        """Words equal to the word before them."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of five words that occurs at least twice in the text.

    Windows get exact numbers by doubling: words, pairs, fours, fives; nothing is hashed, and a text
    of n words needs a few arrays of n numbers.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    two = np.unique(one[:-1] * len(seen) + one[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:-1] * len(seen) + one[4:], return_inverse=True, return_counts=True)
    if len(count) == len(five):
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(count[five] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[View], bool]


#: The first two are the base rules.
RULES = (
    Rule("too_few_words", lambda v: v.n_words < 10),
    Rule("repeated_windows", lambda v: 100 * v.n_repeat_words > 20 * v.n_words),
    Rule("symbols", lambda v: 10 * v.n_symbols > 2 * v.n_words),
    Rule("repeated_lines", lambda v: 10 * v.n_dup_lines > 3 * len(v.lines)),
    Rule("capitals", lambda v: 10 * v.n_capital_words > 4 * v.n_words),
    Rule("stutter", lambda v: 10 * v.n_stuttered > 2 * v.n_words),
    Rule("word_length", lambda v: not 2 * v.n_words <= v.word_chars <= 20 * v.n_words),
)
BASE = ("too_few_words", "repeated_windows")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Cascade:
    """The order of rules, learnt on the first documents a task sees."""

    def __init__(self, rules: tuple[Rule, ...], sample_docs: int) -> None:
        self.rules, self.left = list(rules), sample_docs
        self.cost = dict.fromkeys((r.name for r in rules), 0.0)
        self.rejected = dict.fromkeys((r.name for r in rules), 0)

    def keeps(self, view: View) -> bool:
        if self.left <= 0:
            return not any(rule.rejects(view) for rule in self.rules)
        kept = True
        for rule in self.rules:
            began = time.perf_counter()
            hit = rule.rejects(View(view.text))
            self.cost[rule.name] += time.perf_counter() - began
            self.rejected[rule.name] += hit
            kept &= not hit
        self.left -= 1
        if not self.left:
            self.order()
        return kept

    def order(self) -> None:
        """Most rejections for its cost first; a rule that rejected nothing counts as half a rejection."""
        self.rules.sort(key=lambda r: -max(self.rejected[r.name], 0.5) / max(self.cost[r.name], 1e-9))


def judge(
    docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, sample_docs: int = 64, counts: bool = False, verdict: str = "kept"
) -> DataFrame:
    """``keep`` columns of ``docs`` and ``verdict``: whether no rule rejects the text.

    ``counts`` adds the numbers the base rules rest on and ``base_failed``; these are worked out for
    every document, so that only the other rules gain from the order.
    """
    base = [r for r in rules if r.name in BASE]

    def start() -> Callable[[Iterator[str]], Iterator[tuple]]:
        cascade = Cascade(rules, sample_docs)

        def each(texts: Iterator[str]) -> Iterator[tuple]:
            for view in map(View, texts):
                first = tuple(getattr(view, c) for c in COUNTS) + (any(r.rejects(view) for r in base),) if counts else ()
                yield *first, cascade.keeps(view)

        return each

    first = {c: T.LongType() for c in COUNTS} | {"base_failed": T.BooleanType()} if counts else {}
    return mapped_texts(docs, keep, first | {verdict: T.BooleanType()}, start)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects."""
    return judge(docs, docs.columns, verdict="__kept", **options).where(F.col("__kept")).drop("__kept")


def op8(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"], counts=True)
