"""Removal of long repeated passages by De Bruijn compaction.

Every window of 50 consecutive words is an edge of a De Bruijn graph, from its first 49 words to its
last 49.  Neighbouring edges of a document that share the same anchor, the least hash of the eight-word
runs in the window, are one path: a window has one anchor, whichever document it stands in, so equal
edges only ever meet under one anchor.  A path is kept as its place and a digest of its words.

- An anchor that one document alone has is on no repeated edge; its paths go.
- Paths of equal digest compact to one by a join on the digest; every document but the smallest that
  has the path repeats all its edges.
- An anchor with several digests branches: there the paths of the smallest documents are opened into
  single edges, and a join on the edges finds those that a smaller document has on another path.

Only paths travel through the joins, about one for twenty words; texts travel once, and those of
documents with a repeat in part a second time.  Before a word goes, the digest is taken again at
the place the joins named, on the text itself.

Nulls, empty and very long texts: a null text counts as empty; texts of under 50 words have no window
and stay.  Texts are taken whole.  Rows without doc_id neither remove nor lose words.  Rows of one
doc_id do not remove words from each other.  An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts, words_of, written

WINDOW, ANCHOR = 50, 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(ANCHOR)], np.uint64)
_NOTHING = sha256(b"").hexdigest()
#: Words whose hashes a task remembers; it starts anew beyond that.
_MEMO = 400_000


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """For each window, given all words' hashes, the least mixed hash of the eight-word runs in it."""
    n = len(hashes) - ANCHOR + 1
    runs = np.zeros(n, np.uint64)
    for j in range(ANCHOR):
        runs += hashes[j : j + n] * _POWERS[j]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    least, span, width = runs, 1, WINDOW - ANCHOR + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


class Words:
    """The words of a text, and digests of runs of them."""

    def __init__(self, text: str | None) -> None:
        self.words = words_of(text)
        self.joined = b" ".join(self.words)
        self.at = [0, *accumulate(len(w) + 1 for w in self.words)]

    def digest(self, start: int, stop: int, size: int = 8) -> bytes:
        return blake2b(self.joined[self.at[start] : self.at[stop] - 1], digest_size=size).digest()

    def number(self, start: int, stop: int) -> int:
        return int.from_bytes(self.digest(start, stop), "little", signed=True)

    def edge(self, start: int) -> tuple[int, int]:
        """96 bits of the window at ``start``, as two numbers."""
        d = self.digest(start, start + WINDOW, 12)
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Paths:
    """Cuts texts into paths; remembers word hashes."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def row(self, text: str) -> tuple:
        """Number of words, SHA-256 of all of them, and for each path its place, anchor and digest."""
        w = Words(text)
        whole = sha256(w.joined).hexdigest()
        if len(w.words) < WINDOW:
            return len(w.words), whole, [], [], []
        anchors = anchors_of(self.hashes(w.words))
        starts = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
        edges = np.diff(np.append(starts, len(anchors)))
        digests = [w.number(s, s + n + WINDOW - 1) for s, n in zip(starts.tolist(), edges.tolist(), strict=True)]
        return len(w.words), whole, ((starts << 32) | edges).tolist(), anchors[starts].view(np.int64).tolist(), digests


def paths_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``whole`` and arrays ``at`` (start, edges), ``anchor`` and ``digest``."""
    longs = T.ArrayType(T.LongType())
    columns = {"n_words": T.LongType(), "whole": T.StringType(), "at": longs, "anchor": longs, "digest": longs}

    def start():
        paths = Paths()
        return lambda texts: map(paths.row, texts)

    return mapped_texts(docs, ["doc_id"], columns, start)


def opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single edges of the paths marked ``open``, where the text has the path's digest."""
    for batch in rows:
        ids, texts, todo = (batch.column(c) for c in ("doc_id", "text", "todo"))
        for doc_id, text, paths in zip(ids, texts, todo, strict=True):
            w = Words(text.as_py())
            found = []
            for path in paths.as_py():
                start, n = path["at"] >> 32, path["at"] & 0xFFFFFFFF
                if path["open"] and _there(w, start, n, path["digest"]):
                    found += [(*w.edge(s), s) for s in range(start, start + n)]
            if found:
                high, low, at = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high, pa.int64()), pa.array(low, pa.int32()), pa.array([doc_id.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32())],
                    names=["e1", "e2", "doc_id", "start"],
                )


def _there(w: Words, start: int, n: int, digest: int) -> bool:
    return start + n + WINDOW - 1 <= len(w.words) and w.number(start, start + n + WINDOW - 1) == digest


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its repeated paths and edges."""
    for batch in rows:
        ids, texts, todo, hits = (batch.column(c) for c in ("doc_id", "text", "todo", "hits"))
        made = []
        for text, paths, edges in zip(texts, todo, hits, strict=True):
            w = Words(text.as_py())
            edge = np.zeros(len(w.words) + 1, np.int64)
            for path in paths.as_py():
                start, n = path["at"] >> 32, path["at"] & 0xFFFFFFFF
                if not path["open"] and _there(w, start, n, path["digest"]):
                    edge[start] += 1
                    edge[start + n + WINDOW - 1] -= 1
            for hit in edges.as_py() or ():
                if hit["start"] + WINDOW <= len(w.words) and w.edge(hit["start"])[0] == hit["e1"]:
                    edge[hit["start"]] += 1
                    edge[hit["start"] + WINDOW] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            bounds = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = b" ".join([x for x, out in zip(w.words, gone.tolist(), strict=True) if not out])
            made.append((len(w.words), int(gone.sum()), sha256(kept).hexdigest(), bounds.tolist()))
        cells = list(zip(*made, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "bounds"])


def repeats(docs: DataFrame) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by a space)
    and ``bounds``, the word places at which removed stretches begin and end, in turn."""
    docs = docs.select("doc_id", "text")
    first = written(paths_of(docs))
    paths = first.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("at", "anchor", "digest")).alias("p")).select("doc_id", "p.*")
    shared = paths.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    repeated = written(paths.join(shared, "anchor"))
    compact = repeated.groupBy("anchor", "digest").agg(F.min("doc_id").alias("lo"))
    branching = compact.groupBy("anchor").count().where("count > 1").select(F.col("anchor"), F.lit(True).alias("branches"))
    known = compact.join(branching, "anchor", "left")
    edges = F.col("at").bitwiseAND(0xFFFFFFFF)
    settled = (
        repeated.join(known, ["anchor", "digest"])
        .select("doc_id", edges.alias("edges"), F.struct("at", "digest", (F.col("lo") == F.col("doc_id")).alias("open")).alias("path"), "branches")
        .where("not path.open or branches")
    )
    by_doc = settled.groupBy("doc_id").agg(F.sum(F.expr("if(path.open, 0, edges)")).alias("gone"), F.collect_list("path").alias("todo"))
    all_edges = first.groupBy("doc_id").agg(F.sum(F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))).alias("edges"))
    decided = written(by_doc.join(all_edges, "doc_id").select("doc_id", "todo", (F.col("gone") == F.col("edges")).alias("all_gone")))

    partly = written(docs.join(decided.where("not all_gone").select("doc_id", "todo"), "doc_id"))
    single = partly.where("exists(todo, p -> p.open)").mapInArrow(opened, "e1 long, e2 int, doc_id long, start int")
    low = single.groupBy("e1", "e2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("e1", "e2", "lo")
    hits = single.join(low, ["e1", "e2"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list(F.struct("start", "e1")).alias("hits"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, bounds array<long>"
    cut = partly.join(hits, "doc_id", "left").select(F.col("doc_id").cast("long"), "text", "todo", "hits").mapInArrow(_cut, schema)

    rest = first.select("doc_id", "n_words", "whole").join(decided.select("doc_id", "all_gone"), "doc_id", "left").where("all_gone is null or all_gone")
    gone = F.col("all_gone").isNotNull() & (F.col("n_words") >= WINDOW)
    plain = rest.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(gone, F.lit(_NOTHING)).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(gone, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.array().cast("array<long>")).alias("bounds"),
    )
    return plain.unionByName(cut)


def op5(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
