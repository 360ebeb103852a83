"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash and multi-index hashing (``simhash``): every distinct set has the fingerprint of its five-word
shingles, and the indexes give fingerprints that differ in two bits at most.  Each set is checked exactly against
one near it, and what reaches 0.8 contracts.

Fingerprints alone can't find all: at 0.8 about ten of 64 bits differ, so a search for nearly all would
need a radius near 16, which also meets most unrelated texts in some segment.  The exact similarity
join (``jaccard_join``) adds what they miss to these classes; it loses no link and pairs no group with itself.

Nulls, empty and very long texts: a null text counts as empty, and empty texts are copies of one another.
A text of up to five words is one shingle.  Texts are taken whole.  Of a class the row with the smallest
doc_id stays, then that of the smallest text hash; of equal rows one.  Rows without doc_id link others
like any row, but are in no group themselves, and stay.  An empty table gives an empty result.  Other
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import small_side, written
from storyloom.llm.jaccard_join import Setting, groups
from storyloom.llm.simhash import links

NEAR = Setting(size=5, percent=80)


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of sets (``v``, ``fp``) whose fingerprints differ in two bits at most, in proportion to the sets.

    The first set of a fingerprint meets that of its smallest linked fingerprint, and the others of its own meet it.
    """
    one = written(sets.groupBy("fp").agg(F.min("v").alias("head")))
    near = links(one.select("fp")).groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("low"))
    across = near.join(one.select(F.col("fp").alias("low"), F.col("head").alias("a")), "low").join(one, "fp")
    within = sets.join(one, "fp").where("v <> head")
    return written(across.select("a", F.col("head").alias("b")).unionByName(within.select(F.col("head").alias("a"), F.col("v").alias("b"))))


def keep_first(docs: DataFrame, setting: Setting = NEAR) -> DataFrame:
    """The rows of ``docs``, all columns, one for each class."""
    named = groups(docs, setting, by_fingerprint).where("doc_id is not null").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "times")).alias("first"))
    first = written(least.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("own"), "first.times"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("own")).join(small_side(first), ["id", "own"])
    again = rows.where("times > 1").groupBy("id", "own").agg(F.min_by("row", F.hash("row")).alias("row"))
    return rows.where("times = 1").select("row.*").unionByName(again.select("row.*")).unionByName(docs.where("doc_id is null"))
