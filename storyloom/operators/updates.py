"""Helpers of the table-to-table operators.

Operators read keys and dates, derive a narrow table of changes, and join that
table to the wide one once.  Which side is broadcast is left to adaptive
execution, which knows the bytes a batch's keys and changes came to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, requests: DataFrame | None = None, **columns: str) -> DataFrame:
    """Left-join columns of ``table`` and say in ``has_<key>`` whether there was a row.

    The table is first cut to the keys asked for.  The keys are read from ``requests``, so a chain of
    lookups does not repeat the earlier ones.  Rows without a key match nothing and are spread by a
    hash of the row, so that they do not meet in one task.
    """
    source = rows if requests is None else requests
    keys = source.select(F.col(key).alias(table_key)).filter(F.col(table_key).isNotNull())
    picked = [F.col(column).alias(name) for name, column in columns.items()]
    found = table.select(F.col(table_key), *picked).join(keys.distinct(), table_key, "left_semi").withColumnRenamed(table_key, "_found")
    spread = rows.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long")))
    same = (F.col(key) == F.col("_found")) & (F.col("_spread") == F.col("_zero"))
    joined = spread.join(found.withColumn("_zero", F.lit(0).cast("long")), same, "left")
    return joined.withColumn(f"has_{key}", F.col("_found").isNotNull()).drop("_found", "_spread", "_zero")


def change_rows(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replace the columns of ``changes`` in the rows of ``table`` it names (unique key)."""
    names = [c for c in changes.columns if c != key]
    packed = changes.select(key, F.struct(*names).alias("_new"))
    joined = table.join(packed, key, "left")

    def value(name: str) -> Column:
        old = F.col(name) if name in table.columns else F.lit(None)
        return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(old)

    return joined.withColumns({name: value(name) for name in names}).drop("_new")


def delete_rows(table: DataFrame, gone: DataFrame, key: str = "id", gone_key: str = "id") -> DataFrame:
    return table.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti")


def not_stored(fresh: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key the stored table does not have.

    The big table is cut to the keys of the batch first; the anti-join then
    meets two small sides.
    """
    present = table.select(*keys).join(fresh.select(*keys).distinct(), keys, "left_semi").distinct()
    return fresh.join(present, keys, "left_anti")


def left_by_story(articles: DataFrame, per_story: DataFrame) -> DataFrame:
    """Left-join one row per ``event_id`` to articles, of which many may have no story.

    Ids are not negative, so an article without a story gets a key of its own
    below zero: it matches nothing and does not pile up with the others.
    """
    key = F.when(F.col("event_id").isNull(), -1 - F.col("id")).otherwise(F.col("event_id"))
    return articles.withColumn("_story", key).join(per_story.withColumnRenamed("event_id", "_story"), "_story", "left").drop("_story")


def feedback_rows(rows: DataFrame, kind, now: Column, article: Column | None = None, original: Column | None = None, corrected: Column | None = None, note: Column | None = None) -> DataFrame:
    """Rows for the corrections log."""
    null = F.lit(None)
    return rows.select(
        (F.lit(0) if article is None else article).cast("long").alias("article_id"),
        (null if original is None else original).cast("long").alias("original_event_id"),
        (null if corrected is None else corrected).cast("long").alias("corrected_event_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (null if note is None else note).cast("string").alias("note"),
        now.alias("created_at"),
    )


def append_feedback(feedback: DataFrame, rows: DataFrame) -> DataFrame:
    """Add log rows with fresh ids; equal rows stay apart by their running number."""
    from storyloom.operators.ids import with_new_ids

    key = F.concat_ws("|", "kind", "article_id", F.coalesce("original_event_id", F.lit(-1)), F.coalesce("corrected_event_id", F.lit(-1)), F.coalesce("note", F.lit("")))
    once = rows.withColumn("_key", key).groupBy("_key", *rows.columns).agg(F.count("*").alias("_n"))
    repeated = once.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).withColumn("_key", F.concat_ws("#", "_key", "_i"))
    return feedback.unionByName(with_new_ids(repeated, "_key", feedback).drop("_key", "_n", "_i"), allowMissingColumns=True)
