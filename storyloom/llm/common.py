"""Shared helpers of the training-data operators: reading tables, Arrow loops, lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import cut_lineage, shared_dir

__all__ = ["ARROW", "ASCII_SPACE", "cut_lineage", "mapped_texts", "numbered", "read_table", "small_side", "texts_of", "words_of", "written"]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

ARROW = {
    T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: runs of anything but ASCII white space; null has none."""
    return text.encode().split() if text else []


def texts_of(column: pa.Array) -> Iterator[str]:
    """One text at a time, null as empty, so that a batch's texts are never all decoded at once."""
    for cell in column:
        yield cell.as_py() or ""


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return pa.list_(_arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else ARROW[kind]


def mapped_texts(docs: DataFrame, keep: list[str], columns: dict[str, T.DataType], start: Callable) -> DataFrame:
    """``keep`` columns of ``docs`` beside what a per-task function gives for each text.

    ``start()`` runs once a task and returns the function: an iterator of texts in, one tuple in the
    order of ``columns`` out for each.  Only ``keep`` and ``text`` are read, whatever else ``docs`` has.
    """
    source = "text" if "text" in keep else "__text"
    chosen = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(source))
    schema = T.StructType([T.StructField(c, chosen.schema[c].dataType) for c in keep] + [T.StructField(c, t) for c, t in columns.items()])
    kinds = [_arrow_type(t) for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            rows = list(each(texts_of(batch.column(source))))
            cells = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            made = [pa.array(c, type=k) for c, k in zip(cells, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *columns])

    return chosen.mapInArrow(run, schema)


#: Rows of a few numbers each that a join may send to every executor: some 30 MB.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows.

    Beyond that it is left to a shuffled join.  So texts stay where they are while their keys are few.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and lineage ends there.

    The folder is the session's; it goes with the rest of the session's shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0: a sort by range over the cluster, no task sees all rows.

    Only the number of rows of each range is added up in one place.
    """
    at = f"{name}_at"
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id has the range in its upper bits and the place within it in the lower 33.
    placed = written(ranges.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = placed.groupBy(part.alias(f"{name}_range")).agg(F.count("*").alias("n"))
    before = Window.orderBy(f"{name}_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(f"{name}_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{name}_start"))
    # As many rows as there are ranges.
    joined = placed.withColumn(f"{name}_range", part).join(F.broadcast(starts), f"{name}_range")
    return joined.withColumn(name, F.col(f"{name}_start") + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, f"{name}_range", f"{name}_start")
