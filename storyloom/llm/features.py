"""Bag features of texts as 32-bit keys, and linear models on them in numpy.

A feature is the CRC-32 of a word, of a word's first letters, or of a named shape of the whole text
(share of symbols, capitals, repeats).  A model keeps the keys that tell its groups of sample documents apart, so other
words cost nothing and no two kept words share a weight by a small table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts, written

_WORDS = re.compile(r"\w+")
_SYMBOLS = "#*$%&|<>!"
#: Lengths of word beginnings that are features of their own.
BEGINNINGS = (3, 4, 5)


def _level(part: int, whole: int) -> int:
    """0 for none, else 1 to 9 by the share in steps that grow."""
    return int(np.searchsorted((0, 0.002, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8), part / max(whole, 1), side="left"))


def shape_names(text: str, words: list[str], distinct: int) -> list[str]:
    spaced = text.split()
    return [
        f"\0symbols{_level(sum(map(text.count, _SYMBOLS)), len(spaced))}",
        f"\0capitals{_level(sum(map(str.isupper, spaced)), len(spaced))}",
        f"\0stutter{_level(sum(map(str.__eq__, words, words[1:])), len(words))}",
        f"\0repeats{_level(len(words) - distinct, len(words))}",
        f"\0length{len(words).bit_length()}",
    ]


def _parts(text: str) -> tuple[set[str], list[str]]:
    """The distinct words of a text and its shape features."""
    words = _WORDS.findall(text.lower())
    distinct = set(words)
    return distinct, shape_names(text, words, len(distinct))


def _names(word: str, beginnings: tuple[int, ...]) -> list[str]:
    """The features a word stands for: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in beginnings if len(word) > n)]


def _key(name: str) -> int:
    return crc32(name.encode())


def keys_of(text: str, beginnings: tuple[int, ...] = BEGINNINGS) -> np.ndarray:
    """The distinct feature keys of a text, ascending; an empty text has shape features alone."""
    words, shapes = _parts(text)
    names = words.union(shapes, *({"^" + w[:n] for w in words if len(w) > n} for n in beginnings))
    return np.unique(np.fromiter(map(_key, names), np.uint32, len(names)))


class Rows:
    """Feature keys of many texts, cut to the keys ``kept``."""

    def __init__(self, keys: list[np.ndarray], kept: np.ndarray) -> None:
        self.kept, self.n = kept, len(keys)
        places = []
        for own in keys:
            at = np.minimum(np.searchsorted(kept, own), max(len(kept) - 1, 0))
            places.append(at[kept[at] == own] if len(kept) else at[:0])
        self.at = np.concatenate([*places, np.zeros(0, np.int64)])
        self.row = np.repeat(np.arange(self.n), [len(x) for x in places])

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], self.n) + bias

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, slope[self.row], len(self.kept))


def telling_keys(groups: list[list[np.ndarray]], least_z: float = 4.0, min_texts: int = 4) -> np.ndarray:
    """Keys whose share of texts in some group differs from that in all the others by ``least_z`` standard errors."""
    flat = [np.concatenate([*g, np.zeros(0, np.uint32)]) for g in groups]
    keys, count = np.unique(np.concatenate(flat), return_counts=True)
    keys, count = keys[count >= min_texts], count[count >= min_texts]
    total, keep = sum(map(len, groups)), np.zeros(len(keys), bool)
    for group, own in zip(groups, flat, strict=True):
        n = len(group)
        if not 0 < n < total:
            continue
        have, times = np.unique(own, return_counts=True)
        inside = np.zeros(len(keys))
        if len(have):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            inside = np.where(have[at] == keys, times[at], 0)
        share = count / total
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n + 1 / (total - n)))
        keep |= np.abs(inside / n - (count - inside) / (total - n)) >= least_z * error
    return keys[keep]


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Weights:
    """One or more linear scores over kept keys, for use inside tasks."""

    #: Words whose kept keys a task remembers; it starts anew beyond that.
    MEMO = 400_000

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: np.ndarray, beginnings: tuple[int, ...] = BEGINNINGS) -> None:
        self.kept, self.weights, self.bias, self.beginnings = kept, weights, bias, beginnings
        self.place = {k: n for n, k in enumerate(kept.tolist())}
        self.memo: dict[str, tuple[int, ...]] = {}

    def scores(self, text: str) -> np.ndarray:
        """One number for each column of ``weights``."""
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        words, shapes = _parts(text)
        found = {self.place[k] for k in map(_key, shapes) if k in self.place}
        memo = self.memo
        for word in words:
            here = memo.get(word)
            if here is None:
                here = memo[word] = tuple(self.place[k] for k in map(_key, _names(word, self.beginnings)) if k in self.place)
            if here:
                found.update(here)
        return self.bias + self.weights[sorted(found)].sum(0)


def sample_by_hash(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows, those whose doc_id has the smallest hash: the same on every run, spread over the table."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def sample_keys(docs: DataFrame, chosen: DataFrame, bound: int, beginnings: tuple[int, ...] = BEGINNINGS) -> list[tuple]:
    """Feature keys of the documents in ``chosen`` (at most ``bound`` rows of doc_id and a label): pairs of label and keys.

    What is broadcast is at most ``bound`` ids, what comes back the keys of as many texts; of a doc_id
    with several texts each counts.
    """
    texts = docs.join(F.broadcast(chosen.limit(bound)), "doc_id").select("text", "label")

    def start():
        return lambda texts: ((keys_of(t, beginnings).tobytes(),) for t in texts)

    found = mapped_texts(texts, ["label"], {"keys": T.BinaryType()}, start).limit(2 * bound)
    return [(r.label, np.frombuffer(r["keys"], np.uint32)) for r in found.toLocalIterator()]


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts have each key, by label."""
    own: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for batch in batches:
        for label, keys in zip(batch.column("label").to_pylist(), batch.column("keys"), strict=True):
            own[label].append(np.frombuffer(keys.as_buffer(), np.uint32))
    for label, parts in own.items():
        keys, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint32)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array([label] * len(keys), pa.int32()), pa.array(n.astype(np.int64))], names=["key", "label", "n"])


def telling_sample(docs: DataFrame, chosen: DataFrame, bound: int, least_z: float, min_texts: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Keys that tell two classes of sampled documents apart, and of each text of class 1 and class 0 those of them that it has.

    ``chosen`` has at most ``bound`` rows of doc_id and a label, 0 or 1; of a doc_id with several texts one
    counts, that of the least keys.  Keys are counted by class in Spark; what reaches the driver is the telling
    keys, and their places for at most ``bound`` texts, however long these are.
    """
    texts = docs.join(F.broadcast(chosen.limit(bound)), "doc_id").select("doc_id", "label", "text")

    def start():
        return lambda texts: ((keys_of(t).tobytes(),) for t in texts)

    found = mapped_texts(texts, ["doc_id", "label"], {"keys": T.BinaryType()}, start)
    rows = written(found.groupBy("doc_id", "label").agg(F.min("keys").alias("keys")))
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint32), [np.zeros(0, np.uint32)] * n1, [np.zeros(0, np.uint32)] * n0
    one = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    counts = rows.select("label", "keys").mapInArrow(_key_counts, "key long, label int, n long").groupBy("key").agg(one(1).alias("a"), one(0).alias("b"))
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    telling = counts.where(F.col("a") + F.col("b") >= min_texts).where(F.abs(F.col("a") / n1 - F.col("b") / n0) >= least_z * error)
    kept = np.sort(np.array([r.key for r in telling.select("key").toLocalIterator()], np.uint32))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.intersect1d(np.frombuffer(k.as_buffer(), np.uint32), kept, assume_unique=True).tobytes() for k in batch.column("keys")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(cells, pa.binary())], names=["doc_id", "label", "keys"])

    told = sorted(((r.label, r.doc_id, r["keys"]) for r in rows.mapInArrow(placed, rows.schema).toLocalIterator()), key=lambda r: r[:2])
    own = lambda want: [np.frombuffer(keys, np.uint32) for label, _, keys in told if label == want]
    return kept, own(1), own(0)
