"""Similarity join of documents on word shingles, by adaptive multi-match prefixes.

Two sets of shingles link if their Jaccard similarity reaches the bound.  Then both share at least
t = ceil(bound * n) shingles with each other, so under any one order of all shingles their first
n - t + l share at least l, for every l up to t; of two documents that chose different lengths, at least
the smaller l.  Nothing is left to chance: every link is found, and no bound on a list drops any.

1. Equal sets are one vertex.  Empty sets link with nothing.
2. Lead filter, shuffling a small share of all shingles: under the order of hashes each set's first n - t + l,
   with an l that grows with n, are counted over all sets.  A set that shares fewer than its partners'
   l of them with anybody has no link, and goes.
3. For the sets that are left, shingles are ordered by the exact number of sets that hold them, rarest
   first.  Those that one set alone holds can't be shared: a set with fewer than t others goes.
   Each set lengthens its prefix to the l of least estimated cost: the lists it stands on are read
   (the sum of their lengths), and of those met at least l times, at most that sum over l, each is verified.
4. Classes, not pairs.  The members of a list first meet one head each, of all the heads on their lists
   that which leads most places; a head is the member with the most common shingles, so the original of
   a group of edited copies.  What links contracts, and lists within one class close.
5. Let x and y have been compared with one head h, and lack dx and dy of its shingles.  At most
   |h| - max(dx, dy) of h are common to both, so if that is too few for their sizes, they link only if they
   share a shingle that h lacks.  Such extras are few: their lists, for each head, go through the same
   step of heads, and then members of different classes on them meet.
6. Members of different classes on one list of step 3 meet where that bound does not hold, or where they were
   compared with different heads; pairs met on fewer lists than asked for are not verified.

Verification compares whole sets.  Shingles are 64-bit hashes.

A null text counts as empty.  A text of fewer words than a shingle is one shingle.  Texts are taken whole;
a set is one row.  Repeated rows and rows without doc_id keep their rows; a class without any
doc_id has a null ``component_id``.  Ties between heads go to the smaller number.  An empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts, small_side, written
from storyloom.llm.simhash import components, fingerprint_of, shingle_hashes

#: Matches that a prefix may ask for at most.
MOST_MATCHES = 8


class Setting(NamedTuple):
    """Words in a shingle, and the least similarity in hundredths."""

    size: int = 3
    percent: int = 90

    def least_shared(self, n):
        """What a set of n shares with any set it links with, for numbers and columns."""
        return (self.percent * n + 99) // 100 if isinstance(n, int) else F.ceil(self.percent * n / 100)

    def lead_matches(self, n: int) -> int:
        """Matches asked for in the lead of a set of n: a tenth of it, and never beyond what is shared."""
        return 1 + n // 10 if n > 1 else n

    def lead_length(self, n: int) -> int:
        return n - self.least_shared(n) + min(self.lead_matches(n), self.least_shared(n)) if n else 0

    def lead_needed(self, n: int) -> int:
        """The least that any partner asks for; none is smaller than ``least_shared``."""
        small = self.least_shared(n)
        return min(self.lead_matches(small), self.least_shared(small))


def shingle_set(text: str, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(np.fromiter(shingle_hashes(text, size), np.uint64))


def sketches(docs: DataFrame, keep: list[str], setting: Setting, prints: bool = False) -> DataFrame:
    """``keep`` columns, ``set_id``, ``n`` distinct shingles, the ``lead`` and how many of it must be ``needed``;
    with ``prints`` also the SimHash fingerprint ``fp`` of all shingles, repeats included."""

    def start():
        def each(texts):
            for text in texts:
                hashes = np.fromiter(shingle_hashes(text, setting.size), np.uint64)
                own = np.unique(hashes)
                n = len(own)
                found = xxhash.xxh3_128_digest(own.tobytes()), n, own[: setting.lead_length(n)].view(np.int64).tolist(), setting.lead_needed(n) if n else 0
                yield (*found, fingerprint_of(hashes)) if prints else found

        return each

    columns = {"set_id": T.BinaryType(), "n": T.LongType(), "lead": T.ArrayType(T.LongType()), "needed": T.LongType()}
    return mapped_texts(docs, keep, columns | ({"fp": T.LongType()} if prints else {}), start)


def _common(tokens: DataFrame) -> DataFrame:
    """``token`` and ``df`` of those that more than one vertex has."""
    return tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")


def led(vertices: DataFrame) -> DataFrame:
    """Vertices that share enough of their lead with others to have a link, without the lead."""
    tokens = vertices.select("v", F.explode("lead").alias("token"))
    hits = tokens.join(_common(tokens), "token").groupBy("v").agg(F.count("*").alias("hits"))
    return vertices.drop("lead").join(hits, "v").where("hits >= needed").drop("hits", "needed")


def whole_sets(docs: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """``v``, ``n`` and the whole set ``own`` of each vertex, from the text of its first row."""

    def start():
        return lambda texts: ((shingle_set(t, size).view(np.int64).tolist(),) for t in texts)

    wanted = vertices.select("v", "n", F.col("first.doc_id").alias("__doc"), F.col("first.text_hash").alias("__hash"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = rows.join(small_side(wanted), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))).select("v", "n", "text")
    sets = written(mapped_texts(texts, ["v", "n"], {"own": T.ArrayType(T.LongType())}, start))
    # Rows that are alike in id and text give a set more than once; else nothing needs to move.
    if sets.count() > sets.agg(F.count_distinct("v")).first()[0]:
        sets = written(sets.groupBy("v").agg(F.first("n").alias("n"), F.first("own").alias("own")))
    return sets


def prefixes(sets: DataFrame, setting: Setting) -> DataFrame:
    """Sets that can have a link: ``v``, ``n``, their ``m`` ``shared`` shingles, rarest first, matches ``l`` to ask for,
    ``prefix`` (the shared part of it), and ``common``, how many sets hold a shingle of it on average."""
    tokens = sets.select("v", F.explode("own").alias("token"))
    known = tokens.join(_common(tokens), "token").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))
    able = known.join(sets.select("v", "n"), "v").select("v", "n", "x", F.size("x").cast("long").alias("m"), setting.least_shared(F.col("n")).alias("t")).where("m >= t")
    cost = f"""array_min(transform(sequence(1L, least(t, {MOST_MATCHES}L)), l -> struct(
        aggregate(slice(x, 1, CAST(m - t + l AS int)), 0D, (a, e) -> a + e.df - 1) * (1 + n / l) AS cost, l AS l))).l"""
    chosen = able.withColumn("l", F.expr(cost))
    return chosen.select(
        "v", "n", "m", "l", F.expr("transform(x, e -> e.token)").alias("shared"), F.expr("transform(slice(x, 1, CAST(m - t + l AS int)), e -> e.token)").alias("prefix"),
        F.expr("(aggregate(x, 0D, (a, e) -> a + e.df) + n - m) / n").alias("common"),
    )


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) with both sizes, their ``overlap``, and the ``extras``: what b shares with others but not with a."""
    one = lambda x: sets.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"set{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("seta", "setb")).alias("overlap"), F.array_except("setb", "seta").alias("extras"))


def _reaches(setting: Setting, overlap: Column, n: str, other: str) -> Column:
    """Whether so many common shingles are enough for sets of two sizes."""
    return (100 + setting.percent) * overlap >= setting.percent * (F.col(n) + F.col(other))


def _open(lists: DataFrame, *key: str) -> DataFrame:
    """Members of the lists that hold more than one class."""
    split = lists.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*key)
    return lists.join(split, list(key), "left_semi")


def _stars(lists: DataFrame, setting: Setting, *key: str) -> DataFrame:
    """One pair for a member: ``b``, and as ``a`` that head of its lists which leads most places of all; classes differ."""
    heads = lists.groupBy(*key).agg(F.max_by(F.struct("v", "n", "m", "root"), F.struct("common", -F.col("v"))).alias("top"))
    met = lists.join(heads, list(key)).where("root <> top.root").where(_reaches(setting, F.least("m", "top.m"), "n", "top.n"))
    counted = written(met.groupBy("v", F.col("top.v").alias("a")).agg(F.count("*").alias("times")))
    led = counted.groupBy("a").agg(F.sum("times").alias("places"))
    best = counted.join(led, "a").groupBy(F.col("v").alias("b")).agg(F.max_by("a", F.struct("places", -F.col("a"))).alias("a"))
    return written(best.select("a", "b"))


def _sides(lists: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(lists.select(*(F.col(c).alias(c if c in ("token", "head") else c + x) for c in columns)) for x in "ab")


def classes(prefixed: DataFrame, setting: Setting, candidates: DataFrame | None = None) -> DataFrame:
    """``v`` and the ``root`` of its class, from what ``prefixes`` gives.

    ``candidates`` (``a``, ``b``) are pairs found by other means: those that reach the bound link first.
    """
    sets = prefixed.select("v", "n", "shared")
    roots = prefixed.select("v", F.col("v").alias("root"))
    lists = prefixed.select(F.explode("prefix").alias("token"), "v", "n", "m", "common", F.col("v").alias("root"))
    first = _stars(lists, setting, "token")
    against = written(compared(first, sets))
    linked = against if candidates is None else against.unionByName(compared(candidates, sets))
    linked = linked.where(_reaches(setting, F.col("overlap"), "na", "nb"))
    roots = _merged(roots, linked.select("a", "b"))

    # Every vertex under one head: that which it was compared with, or itself where it was compared with none.
    under = against.select(F.col("b").alias("v"), F.col("a").alias("head"), "overlap")
    known = prefixed.select("v", "n", "m", "l", "common").join(roots, "v").join(under, "v", "left")
    known = written(known.select("v", "n", "m", "l", "common", "root", F.coalesce("head", "v").alias("head"), F.coalesce("overlap", "n").alias("overlap")))

    more = against.select(F.col("b").alias("v"), F.explode("extras").alias("token")).join(known, "v").where("v <> head")
    more = written(_open(more, "head", "token"))
    second = _stars(more, setting, "head", "token")
    again = written(compared(second, sets))
    before, roots = roots, _merged(roots, again.where(_reaches(setting, F.col("overlap"), "na", "nb")).select("a", "b"))
    if roots is not before:
        more, known = more.drop("root").join(roots, "v"), known.drop("root").join(roots, "v")

    enough = _reaches(setting, F.least("ma", "mb"), "na", "nb")
    apart = (F.col("va") < F.col("vb")) & (F.col("roota") != F.col("rootb"))
    a, b = _sides(_open(more, "head", "token"), "head", "token", "v", "n", "m", "root")
    sharing = a.join(b, ["head", "token"]).where(apart & enough).select(F.col("va").alias("a"), F.col("vb").alias("b"))

    lists = prefixed.select(F.explode("prefix").alias("token"), "v").join(known.drop("common"), "v")
    lists = _open(lists, "token")
    smallest = lists.groupBy("token").agg(F.min("n").alias("least"))
    lists = written(lists.join(smallest, "token").where(_reaches(setting, F.col("m"), "n", "least")).drop("least"))
    parts = written(lists.groupBy("token", "head").agg(F.min("n").alias("least"), F.max("m").alias("most")))
    within = lists.join(parts, ["token", "head"]).where(_reaches(setting, F.col("overlap"), "n", "least")).drop("least", "most")
    a, b = _sides(_open(within, "token", "head"), "token", "head", "v", "n", "m", "l", "root", "overlap")
    within = a.join(b, ["token", "head"]).where(apart & enough & _reaches(setting, F.least("overlapa", "overlapb"), "na", "nb"))

    a, b = _sides(lists, "token", "head", "v", "n", "m", "l", "root")
    other = parts.withColumnRenamed("head", "to")
    over = a.join(other, "token").where(F.col("head") != F.col("to")).where(_reaches(setting, F.least("ma", "most"), "na", "least"))
    between = over.drop("head", "least", "most").withColumnRenamed("to", "head").join(b, ["token", "head"]).where(apart & enough)
    pair = ["va", "vb", "la", "lb"]
    often = within.select(*pair).unionByName(between.select(*pair)).groupBy(F.col("va").alias("a"), F.col("vb").alias("b")).agg(F.count("*").alias("times"), F.first(F.least("la", "lb")).alias("l"))
    pairs = often.where("times >= l").select("a", "b").unionByName(sharing).distinct()
    seen = first.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last = compared(written(pairs.join(seen, ["a", "b"], "left_anti")), sets)
    return _merged(roots, last.where(_reaches(setting, F.col("overlap"), "na", "nb")).select("a", "b"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with the classes that ``links`` join made one; the same frame where there is none.

    Tables are written rather than checkpointed here: a checkpoint keeps the product of all its joins as
    its estimated size, and over the rounds that number alone would come to take minutes.
    """
    of = lambda x: roots.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}"))
    edges = written(links.join(of("a"), "a").join(of("b"), "b").select("root_a", "root_b").where("root_a <> root_b"))
    if edges.isEmpty():
        return roots
    above = components(edges, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("above"))
    return written(roots.join(above, "root", "left").select("v", F.coalesce("above", "root").alias("root")))


def groups(docs: DataFrame, setting: Setting = Setting(), search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n`` distinct shingles, and ``root``, the same for the rows of one class and null for an empty set.

    ``search`` may give candidate pairs ``a``, ``b`` of the distinct sets, from their numbers ``v`` and fingerprints ``fp``.
    """
    keep, own = ["doc_id", "text_hash"], ["fp"] if search else []
    sketched = sketches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keep, setting, bool(search))
    rows = written(sketched.withColumn("r", F.monotonically_increasing_id()))
    first = rows.where("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash", "r", *own)).alias("first"))
    firsts = written(first.select("set_id", F.col("first.r").alias("v"), "first"))
    candidates = search(firsts.select("v", "first.fp")) if search else None
    vertices = rows.select(F.col("r").alias("v"), "n", "lead", "needed").join(small_side(firsts.select("v")), "v", "left_semi")
    vertices = written(led(vertices).join(firsts, "v"))
    sets = whole_sets(docs, vertices, setting.size)
    roots = classes(written(prefixes(sets, setting)), setting, candidates)
    named = firsts.select("set_id", "v").join(roots, "v").select("set_id", F.col("root").alias("named"))
    # A set without a link is a class of its own, by its own name.
    root = F.when(F.col("n") > 0, F.coalesce(F.col("named").cast("string"), F.hex("set_id")))
    return rows.select(*keep, "n", "set_id").join(named, "set_id", "left").select(*keep, "n", root.alias("root"))


def op12(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    rows = written(groups(docs, setting))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
