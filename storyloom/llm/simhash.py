"""Near duplicates by SimHash and multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 have it.  Two fingerprints
are linked if at most two of their 64 bits differ.

Search: the 64 bits are four segments of 16.  Index number s keys a fingerprint by the other three
segments, segment s cleared.  Of two linked fingerprints let s be the last segment in which they
differ: the other three then differ in one bit at most, and that bit is in a segment before s.  So
each fingerprint looks in index s for its own key and for the keys in the Hamming ball of radius one
over the segments before s; whichever of the pair has a 0 where the other has a 1 does the flip, so a
pair is met once.  The complete distance is checked inside the join.  Members of one key agree in 48
bits, so a key never has more than 65,536 members, however large the input or a group of copies.

Equal fingerprints are one vertex, so copies are never paired; components contract towards the
smallest neighbour, which at least halves the vertices in each round.

Nulls, empty and very long texts: a null text counts as empty, and empty texts have fingerprint zero
and are linked like any other.  Texts are taken whole.  A row without doc_id keeps its row, and takes
the smallest doc_id of its component; a component with none has a null ``component_id``.  Repeated
rows stay.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import cut_lineage, mapped_texts

SEED = 42
SEGMENTS, WIDTH = 4, 16
_CHUNK = 1 << 16


def shingle_hashes(text: str, size: int) -> Iterator[int]:
    words = text.encode().lower().split()  # of bytes, lower() changes A-Z alone
    joined = b" ".join(words)
    if len(words) <= size:
        return iter([xxhash.xxh64_intdigest(joined, SEED)] if words else [])
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return (xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :], strict=False))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint, as an unsigned number, of the hashes in all parts: the bits that over half of them have."""
    total, set_bits = 0, np.zeros(64, np.int64)
    for part in parts:
        total += len(part)
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total, bitorder="little").tobytes(), "little")


def _parts(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(part := np.fromiter(islice(hashes, _CHUNK), np.uint64)):
        yield part


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    return majority(_parts(shingle_hashes(text, size)))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The same of shingle hashes, repeats included, as a signed number."""
    return _signed(majority(hashes[at : at + _CHUNK] for at in range(0, len(hashes), _CHUNK)))


def fingerprints(docs: DataFrame, keep: list[str], size: int = 3, name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a signed 64-bit number."""

    def start() -> Callable[[Iterator[str]], Iterator[tuple]]:
        def each(texts: Iterator[str]) -> Iterator[tuple]:
            for text in texts:
                value = fingerprint(text, size)
                yield (value - (1 << 64) if value >> 63 else value,)

        return each

    return mapped_texts(docs, keep, {name: T.LongType()}, start)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) with one or two differing bits, each once."""
    cleared = [~(((1 << WIDTH) - 1) << (WIDTH * s)) & ((1 << 64) - 1) for s in range(SEGMENTS)]
    key = lambda s, fp: F.struct(F.lit(s).cast("byte").alias("seg"), fp.bitwiseAND(F.lit(_signed(cleared[s]))).alias("key"))
    own = F.array(*[key(s, F.col("fp")) for s in range(SEGMENTS)])
    flips = F.array(*[
        F.when(F.col("fp").bitwiseAND(F.lit(_signed(1 << bit))) == 0, key(s, F.col("fp").bitwiseOR(F.lit(_signed(1 << bit)))))
        for s in range(SEGMENTS) for bit in range(WIDTH * s)
    ])
    table = prints.select("fp", F.explode(own).alias("at")).select(F.col("fp").alias("b"), "at.seg", "at.key")
    probes = (
        prints.select("fp", F.explode(own).alias("at")).select(F.col("fp").alias("a"), F.lit(False).alias("flipped"), "at.seg", "at.key")
        .unionByName(
            prints.select("fp", F.explode(F.array_compact(flips)).alias("at"))
            .select(F.col("fp").alias("a"), F.lit(True).alias("flipped"), "at.seg", "at.key"))
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # A flip that leaves nothing to differ in the segment itself has found a pair that is met there without one.
    near = F.when(F.col("flipped"), apart == 2).otherwise((apart <= 2) & (F.col("a") < F.col("b")))
    return probes.join(table, ["seg", "key"]).where(near).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: for each vertex of an edge the smallest vertex of its component.

    Each round hangs every vertex on its smallest neighbour, flattens the trees by pointer doubling, and
    goes on with the edges between different roots, each once.  Roots are local minima, so each round
    at least halves the vertices that still have an edge.
    """
    edges = cut_lineage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parents = cut_lineage(both.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("node"), F.least("x", "least").alias("root")))
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = cut_lineage(parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = cut_lineage(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        ends = parents.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        other = parents.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = cut_lineage(edges.join(ends, "x").join(other, "y").where("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct())
        if edges.isEmpty():
            return labels


def groups(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    prints = cut_lineage(fingerprints(docs, ["doc_id"], size))
    one = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(one))
    linked = one.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, one document for each group: that of the smallest doc_id.

    Of rows with the same doc_id one stays; rows without doc_id have no group and stay.
    """
    named = groups(docs, size).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op7(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
