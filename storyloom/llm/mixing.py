"""Mixing sources to target weights by soft membership.

A softmax classifier, learnt from the labelled table, gives every document a posterior over domains;
its words count towards each domain by that share.  Nonnegative rates per document, one for all at the
start, are then fitted so that the expected words of each domain meet its target: projected gradient on
the least squares of the domain totals.  The residuals are weighted by the inverse of the domains'
second moments over the documents above zero, so all directions converge alike; should such a step
not help, the moments of all documents give one that never overshoots.

A draw cannot take a document more than once, so its rates are kept between zero and one inside the fit.
It starts from all documents and holds the domains' ratios to the leading one, so documents go where a
domain has too much and none needs a rate above one.  A domain with fewer words than its share keeps
what it has and is left out of the ratios; it is reported, as is a fit that does not meet them.

A step needs the domain totals alone, one small sum over the cluster.  A rate is a fold of its
document's posterior over the steps so far, so no iteration writes anything and a lost executor costs
only its own rows.

Nulls, empty and very long texts: a null text counts as empty; an empty text has a posterior, no words
and so no say in the totals, and a rate like any other.  Texts are taken whole.  Labels that are null,
or of no document, teach nothing.  Repeated rows count and are rated one by one.  Without any labelled
document all posteriors are equal; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import cut_lineage, mapped_texts
from storyloom.llm.features import Adam, Rows, Weights, sample_by_hash, sample_keys, telling_keys

#: Domains of the labelled table, in the order of the posterior.
DOMAINS = ("good", "junk", "toxic")
#: Their shares of the expected words.
TARGETS = {"good": 0.92, "junk": 0.05, "toxic": 0.03}


def domain_of() -> Column:
    """Place of a labelled row's domain in ``DOMAINS``; null where the labels don't say."""
    return F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(keys: list[np.ndarray], label: np.ndarray, n_classes: int, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> Weights:
    """Softmax regression on the keys that tell the classes apart."""
    kept = telling_keys([[k for k, y in zip(keys, label, strict=True) if y == c] for c in range(n_classes)])
    rows, truth = Rows(keys, kept), np.eye(n_classes)[label]
    weights = np.zeros((len(kept), n_classes))
    bias = np.log((truth.sum(0) + 0.5) / (len(keys) + 0.5 * n_classes))
    adam = Adam(weights.size + n_classes, rate)
    for _ in range(steps):
        guess = softmax(np.stack([rows.scores(weights[:, c], bias[c]) for c in range(n_classes)], 1))
        slope = (guess - truth) / len(keys)
        gradient = np.stack([rows.gradient(slope[:, c]) for c in range(n_classes)], 1) + l2 * weights
        step = adam.step(np.append(gradient.ravel(), slope.sum(0)))
        weights += step[:-n_classes].reshape(weights.shape)
        bias = bias + step[-n_classes:]
    return Weights(kept, weights, bias, beginnings=())


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000) -> Weights:
    """The classifier, from at most ``max_labelled`` labelled documents, taken by hash of doc_id."""
    known = labels.select("doc_id", domain_of().alias("label")).where("label is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    found = sample_keys(docs, sample_by_hash(known, max_labelled), max_labelled, beginnings=())
    if not found:
        return Weights(np.zeros(0, np.uint32), np.zeros((0, len(DOMAINS))), np.zeros(len(DOMAINS)), beginnings=())
    return train([k for _, k in found], np.array([y for y, _ in found]), len(DOMAINS))


def posteriors(docs: DataFrame, keep: list[str], model: Weights, prefix: str = "") -> DataFrame:
    """``keep`` columns, ``n_words`` and ``posterior``, an array in the order of ``DOMAINS``, named with ``prefix``."""

    def start():
        def each(texts):
            for text in texts:
                yield len(text.encode().split()), softmax(model.scores(text)).tolist()

        return each

    return mapped_texts(docs, keep, {f"{prefix}n_words": T.LongType(), f"{prefix}posterior": T.ArrayType(T.DoubleType())}, start)


class Rates(NamedTuple):
    """Steps taken, and expected words per domain before and after."""

    steps: list[list[float]]
    before: np.ndarray
    target: np.ndarray
    after: np.ndarray
    most: float | None = None

    def column(self, posterior: str = "posterior") -> Column:
        """The rate of a document as an expression over its posterior."""
        return rate_after(self.steps, posterior, self.most)


def rate_after(steps: list[list[float]], posterior: str = "posterior", most: float | None = None) -> Column:
    """1, moved by each step against the posterior and kept at zero or above, and at ``most`` or below if given."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def move(rate: Column, step: Column) -> Column:
        towards = sum((F.element_at(posterior, d + 1) * F.element_at(step, d + 1) for d in range(len(steps[0]))), F.lit(0.0))
        moved = F.greatest(F.lit(0.0), rate - towards)
        return moved if most is None else F.least(F.lit(float(most)), moved)

    return F.aggregate(history, F.lit(1.0), move)


def totals(members: DataFrame, steps: list[list[float]], most: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected words of each domain at these steps, and the second moments of documents not at zero."""
    n = len(DOMAINS)
    p = [F.element_at("posterior", d + 1) for d in range(n)]
    rated = members.select("n_words", "posterior", rate_after(steps, most=most).alias("rate"))
    words, counts = F.col("n_words") * F.col("rate"), F.when(F.col("rate") > 0, F.col("n_words")).otherwise(0)
    sums = [F.sum(words * x) for x in p] + [F.sum(counts * x * y) for x in p for y in p]
    row = np.array([x or 0.0 for x in rated.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()], float)
    return row[:n], row[n:].reshape(n, n)


def fit_rates(members: DataFrame, shares: dict[str, float], total: float | None = None, headroom: float = 1.0, tolerance: float = 1e-6, max_steps: int = 60) -> Rates:
    """Steps whose rates bring the expected words of each domain to ``shares`` of ``total``.

    Without ``total`` it is such that the domain with the largest share keeps ``headroom`` times its
    expected words.  Stops when no domain is off by more than ``tolerance`` of the total.
    """
    now, second = totals(members, [])
    before = now
    share = np.array([shares[d] for d in DOMAINS])
    share = share / share.sum()
    leading = int(share.argmax())
    if total is None:
        total = headroom * before[leading] / share[leading]
    target = total * share
    steps: list[list[float]] = []
    safe = np.linalg.pinv(second, rcond=1e-12)
    miss = lambda x: float((x - target) @ safe @ (x - target))
    while before.sum() > 0 and np.abs(now - target).max() > tolerance * total and len(steps) < max_steps:
        # The moments of the documents still above zero go further; all documents' never overshoot.
        for inverse in (np.linalg.pinv(second, rcond=1e-12), safe):
            step = (inverse @ (now - target)).tolist()
            then, moments = totals(members, [*steps, step])
            if miss(then) < miss(now):
                break
        else:
            break
        steps, now, second = [*steps, step], then, moments
    return Rates(steps, before, target, now)


def fit_draw(members: DataFrame, shares: dict[str, float], tolerance: float = 1e-4, max_steps: int = 60, least_kept: float = 0.9) -> Rates:
    """Steps whose rates, none above one, bring the domains' expected words to their shares.

    Held are the ratios to the domain with the largest share, of each domain that has, or during the fit
    comes to have, more words than its share; ``target`` of another is what it has.  No step is taken that
    leaves the leading domain less than ``least_kept`` of its words: where the posteriors hardly tell the
    domains apart, the shares are missed rather than its documents dropped.  Either is warned of.
    """
    share = np.array([shares[d] for d in DOMAINS])
    leading = int(share.argmax())
    ratio = share / share[leading]
    now, second = totals(members, [], 1.0)
    before, all_documents = now, second
    steps: list[list[float]] = []
    held = np.zeros(len(DOMAINS), bool)
    missed = False
    while before.sum() > 0 and len(steps) < max_steps and not missed:
        held |= now - ratio * now[leading] > tolerance * now.sum()
        held[leading] = False
        # Row d takes a posterior to what its document adds to the excess of domain d.
        over = (np.eye(len(DOMAINS)) - np.outer(ratio, np.eye(len(DOMAINS))[leading]))[held]
        if not held.any() or np.abs(over @ now).max() <= tolerance * now.sum():
            break
        safe = np.linalg.pinv(over @ all_documents @ over.T, rcond=1e-12)
        for inverse in (np.linalg.pinv(over @ second @ over.T, rcond=1e-12), safe):
            step = (over.T @ inverse @ over @ now).tolist()
            then, moments = totals(members, [*steps, step], 1.0)
            closer = (over @ then) @ safe @ (over @ then) < (over @ now) @ safe @ (over @ now)
            if closer and then[leading] >= least_kept * before[leading]:
                steps, now, second = [*steps, step], then, moments
                break
        else:
            missed = True
    target = np.where(held, ratio * now[leading], now)
    short = [d for d, x, r in zip(DOMAINS, now, ratio, strict=True) if r * now[leading] - x > tolerance * now.sum()]
    off = float(np.abs(now - target).max())
    if short:
        warnings.warn(f"mixing: too few words for the share of {', '.join(short)}; all of them stay", stacklevel=2)
    if off > tolerance * now.sum():
        warnings.warn(f"mixing: shares missed, words {dict(zip(DOMAINS, now.tolist(), strict=True))}, targets {dict(zip(DOMAINS, target.tolist(), strict=True))}", stacklevel=2)
    return Rates(steps, before, target, now, 1.0)


def mix(docs: DataFrame, labels: DataFrame, keep: list[str], shares: dict[str, float] = TARGETS, headroom: float = 1.0) -> tuple[DataFrame, Rates]:
    """``keep`` columns, ``n_words``, ``posterior`` and ``rate`` of every row, and how the fit went."""
    members = cut_lineage(posteriors(docs, keep, learn(docs, labels)))
    rates = fit_rates(members, shares, headroom=headroom)
    return members.withColumn("rate", rates.column()), rates


def drawn(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, all columns, each with probability of its rate, which is at most one.

    The draw is a hash of doc_id and text, the same on every run.
    """
    model = learn(docs, labels)
    members = cut_lineage(posteriors(docs, [], model))
    rates = fit_draw(members, shares)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rated = posteriors(docs, docs.columns, model, prefix="__")
    return rated.where(rates.column("__posterior") > chance).select(*docs.columns)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated, _ = mix(docs, labels, ["doc_id"])
    return rated.select("doc_id", "n_words", *[F.element_at("posterior", d + 1).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], "rate")
