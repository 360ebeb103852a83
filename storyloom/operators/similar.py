"""Groups of alike texts: exact similarity of word shingles, without pairing a group with itself.

Two texts are alike if the Jaccard similarity of their sets of three-word shingles reaches a bound.
Then each shares at least t = ceil(bound * n) shingles with the other, so with shingles ordered from rare
to common both have one in common among their first n - t + 1: the prefix.  Shingles of one text alone
can't be common, so a text with fewer than t others has no alike one and leaves.

Texts that stand on one list of a prefix shingle first meet the list's head alone, the member whose
shingles are most common: of edited copies of an article that is the original.  What is alike becomes one
class, lists within one class close, and only members of different classes that are left meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.components import components
from storyloom.session import stored

SHINGLE_WORDS = 3


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``id``, ``own``, the ascending hashes of the distinct shingles of ``text``, and their number ``n``; texts without a word are left out."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    last = F.greatest(F.size("w") - (SHINGLE_WORDS - 1), F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice("w", i, SHINGLE_WORDS), " ")))
    sets = texts.select("id", words.alias("w")).where(F.size("w") > 0).select("id", F.array_sort(F.array_distinct(hashes)).alias("own"))
    return sets.withColumn("n", F.size("own"))


def _enough(shared: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether so many shared shingles reach the bound for sets of two sizes."""
    return (100 + percent) * shared >= percent * (n + other)


def prefixed(sets: DataFrame, percent: int) -> DataFrame:
    """Sets that may have an alike one: ``id``, ``n``, the ``shared`` shingles from rare to common, their number ``m``, the ``prefix``, and how ``common`` the shingles are."""
    tokens = sets.select("id", "n", F.explode("own").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(known, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))
    able = ranked.select("id", "n", F.size("x").alias("m"), F.ceil(F.col("n") * percent / 100).cast("int").alias("t"), "x").where("m >= t")
    return able.select(
        "id", "n", "m", F.transform("x", lambda e: e["token"]).alias("shared"), F.slice(F.transform("x", lambda e: e["token"]), F.lit(1), F.col("m") - F.col("t") + 1).alias("prefix"),
        (F.aggregate("x", F.lit(0.0), lambda s, e: s + e["df"]) / F.col("n")).alias("common"),
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"set_{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    return both.where(_enough(F.size(F.array_intersect("set_a", "set_b")), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _several(lists: DataFrame) -> DataFrame:
    """Members of the lists that hold more than one class."""
    split = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return lists.join(split, "token", "left_semi")


def links_of_alike(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between alike sets (``id``, ``own``, ``n``) that join exactly the classes; not all links of a class."""
    sets = stored(prefixed(sets, percent))
    lists = sets.select(F.explode("prefix").alias("token"), "id", "n", "m", "common", F.col("id").alias("root"))
    lists = stored(_several(lists))
    heads = lists.groupBy("token").agg(F.max_by(F.struct("id", "n", "m"), F.struct("common", -F.col("id"))).alias("head"))
    stars = lists.join(heads, "token").where(F.col("id") != F.col("head.id"))
    stars = stars.where(_enough(F.least("m", "head.m"), F.col("n"), F.col("head.n"), percent)).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    met = stored(stars)
    links = stored(_verified(met, sets, percent))
    roots = components(links).withColumnRenamed("root", "class")
    lists = stored(_several(lists.join(roots, "id", "left").withColumn("root", F.coalesce("class", "root")).drop("class", "common")))
    side = lambda x: lists.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "m", "root")))
    across = side("a").join(side("b"), "token").where("id_a < id_b and root_a <> root_b").where(_enough(F.least("m_a", "m_b"), F.col("n_a"), F.col("n_b"), percent))
    apart = across.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    apart = apart.join(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return links.unionByName(_verified(stored(apart), sets, percent))


def alike_texts(texts: DataFrame, percent: int) -> DataFrame:
    """``id`` and ``root``, the smallest id of its group, of every text (``id``, ``text``) that has a word.

    Texts of equal sets are one before anything is compared.
    """
    sets = stored(shingle_sets(texts).withColumn("name", F.sha2(F.array_join("own", ","), 256)))
    one = stored(sets.groupBy("name").agg(F.min("id").alias("id"), F.first("own").alias("own"), F.first("n").alias("n")))
    roots = components(links_of_alike(one.select("id", "own", "n"), percent))
    named = one.select("name", "id").join(roots, "id", "left").select("name", F.coalesce("root", "id").alias("root"))
    return sets.select("id", "name").join(named, "name").select("id", "root")
