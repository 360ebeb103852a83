"""Ids for new rows without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = 3  # hex digits: 4096 buckets


def with_new_ids(rows: DataFrame, key: str, existing: DataFrame, id_column: str = "id") -> DataFrame:
    """Number ``rows`` (unique ``key``) from ``max(id) + 1`` on, in digest order of the key.

    The number is the size of all lower digest buckets plus the rank inside
    the row's own bucket.  Digests spread any key set evenly, ranks run per
    bucket, and the only window over everything sees one row per bucket.  The
    order depends on the keys alone, so a recomputed task gives the same ids.
    """
    digest = F.md5(F.col(key).cast("string"))
    tagged = rows.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, _PREFIX)})
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    last = existing.select(F.coalesce(F.max(id_column), F.lit(0)).alias("last")).scalar()
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest"))
    numbered = tagged.withColumn("_rank", rank).join(offsets, "_bucket")
    return numbered.withColumn(id_column, last + F.col("_offset") + F.col("_rank")).drop("_digest", "_bucket", "_offset", "_rank")
