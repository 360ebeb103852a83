"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.session import stored


def _large_stars(links: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the smallest vertex it knows."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least("high", F.min("low")).alias("least"))
    return both.join(least, "high").where(F.col("low") > F.col("high")).select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    handed = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return handed.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``root``, the smallest vertex of its component, for each vertex of a link.

    Large and small stars in turn until nothing changes: rounds grow with the logarithm of the longest path, no
    step makes more links than it was given, and no vertex's neighbours are ever collected.  Each
    round's links are stored, so estimated sizes do not multiply over the rounds.
    """
    links = stored(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct())
    mark = None
    while True:
        links = stored(_small_stars(_large_stars(links)))
        found = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low") % (1 << 31))).first()
        if found == mark:
            break
        mark = found
    return links.select(F.col("high").alias("id"), F.col("low").alias("root")).unionByName(links.select(F.col("low").alias("id"), F.col("low").alias("root")).distinct())
