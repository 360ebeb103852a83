"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, everything else is unlabelled text.  The risk of a linear
classifier is the class prior times its loss on positives plus the loss of calling unlabelled text
negative, less the prior times that of calling positives negative; where this corrected negative part
falls below zero, the step goes the other way, so that the model can't win by memorising the
unlabelled sample (Kiryo and others, 2017).  Score is the logistic of the linear score.

Training rows are bounded: at most ``max_positive`` and ``max_unlabelled`` documents, taken by hash of
doc_id from rows the caller allows.  Their features are counted by class in Spark, and only the keys that
tell the classes apart reach the driver.  The prior is the toxic share of the allowed labelled rows, unless given.

Nulls, empty and very long texts: a null text counts as empty and gets a score like any other; texts are
scored whole; labels that are null or belong to no document teach nothing; a null doc_id is scored and
is in no fold.  Repeated rows are scored one by one.  Without any positive, every score is the prior.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts
from storyloom.llm.features import Adam, Rows, Weights, sample_by_hash, sigmoid, telling_keys, telling_sample


class Fit(NamedTuple):
    """What nnPU learning is told."""

    steps: int = 300
    rate: float = 0.05
    l2: float = 3e-4
    least_z: float = 4.0
    min_texts: int = 4
    slack: float = 0.0


def risk(score: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Parts of the risk: of positives, and the corrected one of negatives, with their slopes by score."""
    n_p, n_u = is_p.sum(), (~is_p).sum()
    # Logistic loss: log(1 + exp(-s)) as positive, log(1 + exp(s)) as negative; its slope is sigmoid - label.
    as_negative, up = np.logaddexp(0, score), sigmoid(score)
    positive = prior * np.logaddexp(0, -score[is_p]).mean()
    corrected = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
    return positive, corrected, np.where(is_p, prior * (up - 1) / n_p, 0), np.where(is_p, -prior * up / n_p, up / n_u)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, fit: Fit = Fit(), kept: np.ndarray | None = None) -> Weights:
    """Weights of the classifier with the least non-negative risk, from feature keys of both samples; ``kept`` are the telling ones, if known."""
    if kept is None:
        kept = telling_keys([positive, unlabelled], fit.least_z, fit.min_texts)
    n_p = len(positive)
    rows = Rows(positive + unlabelled, kept)
    is_p = np.arange(rows.n) < n_p
    weights, bias = np.zeros(len(rows.kept)), float(np.log(prior / (1 - prior)))
    adam = Adam(len(weights) + 1, fit.rate)
    for _ in range(fit.steps):
        score = rows.scores(weights, bias)
        _, corrected, positive_slope, negative_slope = risk(score, is_p, prior)
        slope = negative_slope + positive_slope if corrected >= -fit.slack else -negative_slope
        step = adam.step(np.append(rows.gradient(slope) + fit.l2 * weights, slope.sum()))
        weights += step[:-1]
        bias += step[-1]
    return Weights(rows.kept, weights[:, None], np.array([bias]))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, max_positive: int = 6_000, max_unlabelled: int = 12_000, prior: float | None = None, fit: Fit = Fit()) -> tuple[Weights, float]:
    """A classifier from the rows for which ``allowed`` (over doc_id) holds, and the class prior."""
    known = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    if prior is None:
        toxic, n = known.agg(F.count_if(F.col("label") == 1), F.count("*")).first()
        prior = min(max(toxic / n if n else 0.5, 0.001), 0.999)
    positive = sample_by_hash(known.where("label = 1"), max_positive).select("doc_id", F.lit(1).alias("label"))
    plain = sample_by_hash(docs.where(allowed).select("doc_id").distinct(), max_unlabelled).select("doc_id", F.lit(0).alias("label"))
    # A confirmed document may be in both samples, as the risk has it; the label goes with the doc_id.
    both = positive.unionByName(plain)
    kept, p, u = telling_sample(docs, both, max_positive + max_unlabelled, fit.least_z, fit.min_texts)
    if not p or not u:
        return Weights(np.zeros(0, np.uint32), np.zeros((0, 1)), np.array([np.log(prior / (1 - prior))])), prior
    return train(p, u, prior, fit, kept), prior


def score(docs: DataFrame, keep: list[str], model: Weights) -> DataFrame:
    """``keep`` columns, ``score`` from 0 to 1 and ``predicted``, 1 from a score of a half."""

    def start():
        def each(texts):
            for text in texts:
                value = float(sigmoid(model.scores(text))[0])
                yield value, int(value >= 0.5)

        return each

    return mapped_texts(docs, keep, {"score": T.DoubleType(), "predicted": T.IntegerType()}, start)


def held_out(folds: int, which: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == which


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    test = held_out(5, 0)
    model, _ = learn(docs, labels, ~test)
    scored = score(docs, ["doc_id"], model)
    return scored.select("doc_id", F.coalesce(test, F.lit(False)).alias("held_out"), "score", "predicted")
