"""Tables of record on storage: load, snapshot, evolve, export."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import schemas
from storyloom.settings import DEFAULTS

#: Folder of the store's numbered records.
POINTER = "published"


def load_raw_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def run_dir(base: str, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Add the columns an older table lacks, with their defaults."""
    have = set(df.columns)
    special = {
        "expires_at": lambda: F.coalesce(*[F.col(c) for c in ("last_article_at", "created_at") if c in have])
        + F.make_interval(hours=F.lit(DEFAULTS.ttl_hours)),
        "is_paused": lambda: F.lit(False),
    }
    can_backfill = bool(have & {"last_article_at", "created_at"})
    columns = []
    for field in target.fields:
        if field.name in have:
            columns.append(F.col(field.name))
        elif field.name in special and (field.name != "expires_at" or can_backfill):
            columns.append(special[field.name]().cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in target.fieldNames()]
    return df.select(*columns, *extra)


_RECORD = "number long, table string, version string"


def read_if_there(spark: SparkSession, schema: T.StructType | str, path: str, kind: str = "parquet", **options: str) -> DataFrame | None:
    """Files below ``path``; nothing where there is no such path, and any other failure is raised."""
    try:
        return spark.read.format(kind).schema(schema).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class StoreConflict(RuntimeError):
    """Another job has published a table since this one read it."""


class Published(NamedTuple):
    """The newest record's number, and of every table its current version and the number it was published by."""

    number: int
    versions: dict[str, str]
    since: dict[str, int]


def published(spark: SparkSession, base: str) -> Published:
    records = read_if_there(spark, _RECORD, f"{base}/{POINTER}", "json")
    if records is None:
        return Published(0, {}, {})
    current = records.groupBy("table").agg(F.max("number").alias("number"), F.max_by("version", "number").alias("version")).collect()
    return Published(max((r.number for r in current), default=0), {r.table: r.version for r in current}, {r.table: r.number for r in current})


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or leave the one that is there: whether it was written.

    The text goes to a hidden file first, which then takes the name in one step that fails where the name is
    taken: a hard link on a local disk, elsewhere the file system's rename without overwriting.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs_api = jvm.org.apache.hadoop.fs
    target = fs_api.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    draft = fs_api.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            kind = getattr(fs_api, "Options$Rename")
            how = gateway.new_array(kind, 1)
            how[0] = kind.valueOf("NONE")
            fs_api.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, how)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def write_snapshots(
    frames: dict[str, DataFrame], base: str, version: str | None = None, files_by: list[str] | None = None, parent: int | None = None, reads: list[str] | None = None
) -> int:
    """Write new versions of tables, then publish all of them by one record.

    Readers keep the versions they resolved; a job that dies before the record leaves the old versions of
    all tables current.  A record's file bears its number and is only created where there is none, so of
    two jobs that publish at once one takes the number and the other looks again.  With ``parent``, the
    number the job read from, publishing is refused (``StoreConflict``) when one of the tables it writes or
    ``reads`` was published since; changes of other tables are no conflict.  A retry under the same version
    name replaces its own half-written files.
    """
    spark = next(iter(frames.values())).sparkSession
    version = version or uuid.uuid4().hex
    for table, df in frames.items():
        rows = df.repartition(*[F.col(c) for c in files_by]) if files_by else df
        rows.write.mode("overwrite").parquet(f"{base}/{table}/version={version}")
    while True:
        now = published(spark, base)
        changed = [t for t in {*frames, *(reads or [])} if parent is not None and now.since.get(t, 0) > parent]
        if changed:
            raise StoreConflict(f"the store was published as {now.number} since this job read {parent}: {', '.join(sorted(changed))}")
        lines = [json.dumps({"number": now.number + 1, "table": name, "version": version}) for name in frames]
        if create_file(spark, f"{base}/{POINTER}/{now.number + 1:012d}.json", "\n".join(lines) + "\n"):
            return now.number + 1


def write_snapshot(df: DataFrame, base: str, table: str, version: str | None = None, files_by: list[str] | None = None, parent: int | None = None) -> int:
    """A new version of one table."""
    return write_snapshots({table: df}, base, version, files_by, parent)


def store_number(spark: SparkSession, base: str) -> int:
    """Number of the newest record, to be given as ``parent``."""
    return published(spark, base).number


def load_tables(spark: SparkSession, base: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Current version of every table, an empty one where none was written.

    A table whose versions lie there without a record is an error, not an empty table.
    """
    versions = published(spark, base).versions
    loaded = {}
    for name in names or list(schemas.TABLES):
        if name in versions:
            stored = spark.read.parquet(f"{base}/{name}/version={versions[name]}")
            loaded[name] = evolve_schema(stored, schemas.TABLES[name])
        elif read_if_there(spark, "path string", f"{base}/{name}/version=*", "binaryFile") is not None:
            raise RuntimeError(f"{base} has versions of {name} and no record of them")
        else:
            loaded[name] = spark.createDataFrame([], schemas.TABLES[name])
    return loaded


def append_articles(articles: DataFrame, path: str) -> None:
    articles.write.mode("append").parquet(path)


def export_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").json(path)
