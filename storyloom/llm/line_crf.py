"""Document quality from a linear-chain conditional random field over lines.

Each line of a document is good or bad.  A line's score rests on its own features and those of the
lines before and after; neighbouring labels score as pairs.  Forward and backward sums give every
line's probability of being good, and their mean, weighted by the length of the lines, is the
document's share of good text.  A logistic curve fitted on the training documents makes it the score.

The field is trained on documents whose label all their lines take; at most ``max_documents`` of them,
taken by hash of doc_id from the rows the caller allows, and of those the ones of at most ``max_lines``
lines.  They reach the driver as line features.  Scoring has no bounds: all lines of all documents.

Nulls, empty and very long texts: a null text counts as empty, and an empty text is one empty line.
Labels that are null, or of no document, teach nothing; a null doc_id is scored and is in no fold.
Repeated rows are scored one by one.  Without labelled rows of both kinds every score is a half; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts
from storyloom.llm.features import Adam, sample_by_hash, sigmoid

_SYMBOLS = "#*$%&|<>!"
#: Features of a line itself; those of both neighbours and two for the ends follow.
OWN = ("one", "empty", "words", "symbols", "capitals", "stutter", "repeats", "digits", "word_length", "ends", "seen", "symbols_high", "capitals_high", "stutter_high", "repeats_high")
N_FEATURES = 3 * len(OWN) + 2
_RUN_LINES = 20_000


def _own(line: str, seen: set[str]) -> tuple[float, ...]:
    words = line.split()
    n = max(len(words), 1)
    symbols = min(sum(map(line.count, _SYMBOLS)) / n, 1.0)
    capitals = sum(map(str.isupper, words)) / n
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    repeats = 1 - len(set(words)) / n if words else 0.0
    digits = sum(map(line.count, "0123456789")) / max(len(line), 1)
    again = bool(words) and line in seen
    seen.add(line)
    return (
        1.0, not words, np.log1p(len(words)) / 5, symbols, capitals, stutter, repeats, digits, min(len(line) / n / 20, 1.0),
        line.rstrip().endswith((".", "!", "?")), again, symbols > 0.2, capitals > 0.4, stutter > 0.2, repeats > 0.6,
    )


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line, with the neighbours', and the lines' weights: characters, one at least."""
    lines, seen = text.split("\n"), set()
    own = np.array([_own(line, seen) for line in lines], np.float32)
    edge = np.zeros((1, len(OWN)), np.float32)
    ends = np.zeros((len(lines), 2), np.float32)
    ends[0, 0] = ends[-1, 1] = 1
    full = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), ends])
    return full, np.fromiter((max(len(x), 1) for x in lines), np.float64, len(lines))


class Chains:
    """Documents of several lengths in one array of lines, walked a line number at a time."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths
        self.start = (np.cumsum(lengths) - lengths)[self.order]
        sizes = lengths[self.order]
        # How many documents have a line number t; they are the first ones in this order.
        self.active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else np.zeros(0, int)

    def marginals(self, unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each line being good, and for each line but a first one that of its four label pairs.

        ``unary`` is the score of good against bad for each line, ``pairs`` the scores of (label before, label).
        """
        good = sigmoid(unary)
        emit = np.stack([1 - good, good], 1) + 1e-300
        move = np.exp(pairs - pairs.max())
        ahead, back = emit.copy(), np.ones_like(emit)
        two = np.zeros((len(unary), 2, 2))
        if len(self.active):
            first = self.start
            ahead[first] /= ahead[first].sum(1, keepdims=True)
        for t in range(1, len(self.active)):
            at = self.start[: self.active[t]] + t
            step = (ahead[at - 1] @ move) * emit[at]
            ahead[at] = step / step.sum(1, keepdims=True)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            later = emit[at] * back[at]
            both = ahead[at - 1][:, :, None] * move[None] * later[:, None, :]
            two[at] = both / both.sum((1, 2), keepdims=True)
            step = later @ move.T
            back[at - 1] = step / step.sum(1, keepdims=True)
        joint = ahead * back
        return joint[:, 1] / joint.sum(1), two


class Model(NamedTuple):
    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    middle: float

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """The score of each document, given its line features and weights."""
        if not documents:
            return []
        lengths = np.array([len(w) for _, w in documents])
        good, _ = Chains(lengths).marginals(np.concatenate([f @ self.weights for f, _ in documents]), self.pairs)
        parts = np.split(good, np.cumsum(lengths)[:-1])
        shares = np.array([p @ w / w.sum() for p, (_, w) in zip(parts, documents, strict=True)])
        return sigmoid(self.slope * (shares - self.middle)).tolist()


NEUTRAL = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.5)


def train(documents: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """The field with the greatest mean likelihood per line of each document, and the curve for its scores."""
    lengths = np.array([len(w) for _, w in documents])
    chains = Chains(lengths)
    features = np.concatenate([f for f, _ in documents]).astype(np.float64)
    truth = np.repeat(label, lengths).astype(np.float64)
    share = np.repeat(1 / lengths / len(lengths), lengths)
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(truth), bool)
    inner[firsts] = False
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[inner].astype(int), truth[inner].astype(int)), share[inner])
    weights, pairs = np.zeros(N_FEATURES), np.zeros((2, 2))
    adam = Adam(N_FEATURES + 4, rate)
    for _ in range(steps):
        good, two = chains.marginals(features @ weights, pairs)
        down = features.T @ (share * (good - truth)) + l2 * weights
        down_pairs = (two * share[:, None, None]).sum(0) - seen_pairs + l2 * pairs
        step = adam.step(np.append(down, down_pairs.ravel()))
        weights += step[:-4]
        pairs += step[-4:].reshape(2, 2)
    good, _ = chains.marginals(features @ weights, pairs)
    by_doc = np.add.reduceat(good * np.concatenate([w for _, w in documents]), firsts) / np.array([w.sum() for _, w in documents])
    # The curve: logistic regression of the label on the share, by Newton steps with a little ridge.
    x = np.stack([by_doc, np.ones_like(by_doc)], 1)
    line = np.array([1.0, -0.5])
    for _ in range(50):
        p = sigmoid(x @ line)
        line -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - label) + 1e-2 * line)
    slope = float(line[0])
    return Model(weights, pairs, slope, float(-line[1] / slope) if abs(slope) > 1e-9 else 0.5)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, max_documents: int = 6_000, max_lines: int = 1_000) -> Model:
    known = labels.where(allowed & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = sample_by_hash(known, max_documents)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "label")

    def start():
        def each(texts: Iterator[str]) -> Iterator[tuple]:
            for text in texts:
                features, weights = line_features(text) if text.count("\n") < max_lines else (np.zeros((0, N_FEATURES), np.float32), np.zeros(0))
                yield features.tobytes(), weights.tobytes()

        return each

    rows = mapped_texts(texts, ["label"], {"features": T.BinaryType(), "weights": T.BinaryType()}, start).where("length(weights) > 0").limit(2 * max_documents)
    found = [(r.label, np.frombuffer(r.features, np.float32).reshape(-1, N_FEATURES), np.frombuffer(r.weights)) for r in rows.toLocalIterator()]
    label = np.array([y for y, _, _ in found])
    if len(set(label.tolist())) < 2:
        return NEUTRAL
    return train([(f, w) for _, f, w in found], label)


def score(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns, ``score`` from 0 to 1 and ``predicted``, 1 from a score of a half.

    Documents are walked together, as many as have about 20,000 lines.
    """

    def start():
        def each(texts: Iterator[str]) -> Iterator[tuple]:
            run, lines = [], 0
            for text in texts:
                run.append(line_features(text))
                lines += len(run[-1][1])
                if lines >= _RUN_LINES:
                    yield from ((s, int(s >= 0.5)) for s in model.scores(run))
                    run, lines = [], 0
            yield from ((s, int(s >= 0.5)) for s in model.scores(run))

        return each

    return mapped_texts(docs, keep, {"score": T.DoubleType(), "predicted": T.IntegerType()}, start)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = score(docs, ["doc_id"], learn(docs, labels, ~test))
    return scored.select("doc_id", F.coalesce(test, F.lit(False)).alias("held_out"), "score", "predicted")
