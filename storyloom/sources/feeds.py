"""Feed documents and the feed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import host_name
from storyloom.operators.rollups import now_col
from storyloom.settings import DEFAULTS

_TEXT = T.StringType()


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


#: What is read from an RSS or RDF ``<item>``; anything else in it is ignored.
ITEM = T.StructType([
    *_fields(title=_TEXT, link=_TEXT, pubDate=_TEXT, published=_TEXT, updated=_TEXT, description=_TEXT, summary=_TEXT, created=_TEXT),
    T.StructField("content:encoded", _TEXT), T.StructField("dc:date", _TEXT),
])
#: What is read from an Atom ``<entry>``; an address is an attribute there, and there may be several.
ENTRY = T.StructType(_fields(
    title=_TEXT, link=T.ArrayType(T.StructType(_fields(_href=_TEXT, _rel=_TEXT, _VALUE=_TEXT))), published=_TEXT, updated=_TEXT,
    created=_TEXT, issued=_TEXT, summary=_TEXT, content=_TEXT,
))
#: Landing layout: one folder ``feed_id=<id>`` per feed, so the feed is a partition column.
_FEED = T.StructField("feed_id", T.LongType())


def _item_columns() -> list:
    dated = F.coalesce("published", "pubDate", "`dc:date`", "created")
    return ["title", "link", dated.alias("published"), "updated", "summary", "description", F.col("content:encoded").alias("content_value")]


def _entry_columns() -> list:
    """The address is that of the link to the page itself, else the first link's."""
    own = F.try_element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))
    link = F.coalesce(own, F.try_element_at("link", F.lit(1)))
    dated = F.coalesce("published", "issued", "created")
    return ["title", F.coalesce(link["_href"], link["_VALUE"]).alias("link"), dated.alias("published"), "updated", "summary", F.lit(None).cast("string").alias("description"), F.col("content").alias("content_value")]


#: A whole document, whatever its root: items lie in it or in its channel, Atom entries in it.
_DOCUMENT = T.StructType([
    T.StructField("item", T.ArrayType(ITEM)), T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(ITEM))])),
    T.StructField("entry", T.ArrayType(ENTRY)),
])
#: Bits of an entry's place in its document, in the running number of a stream.
PLACE_BITS = 20


def _entries(reader, path: str) -> DataFrame:
    """Entries of landed documents, each with its document's path and time and its ``place`` in it, from 0.

    A document is read and parsed whole, so places depend on nothing but the document.  One that can't be parsed
    to its end gives what it has up to there, or nothing.
    """
    lines = reader.format("text").option("wholetext", True).schema(T.StructType([T.StructField("value", _TEXT), _FEED])).load(path)
    documents = lines.select("feed_id", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"), F.from_xml("value", _DOCUMENT).alias("d"))
    kept = ["feed_id", "_file", "_time", "place"]
    items = F.coalesce("d.item", "d.channel.item")
    rss = documents.select("feed_id", "_file", "_time", F.posexplode(items).alias("place", "e")).select(*kept, "e.*").select(*kept, *_item_columns())
    atom = documents.select("feed_id", "_file", "_time", F.posexplode("d.entry").alias("place", "e")).select(*kept, "e.*").select(*kept, *_entry_columns())
    return rss.unionByName(atom)


def _as_entries(rows: DataFrame) -> DataFrame:
    """``summary_detail`` is the entry's summary whichever element it came in."""
    detail = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("description", F.lit("")))
    return rows.select("feed_id", "pos", "title", "link", "published", "updated", detail.alias("summary_detail"), "summary", "description", "content_value")


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS, RDF and Atom documents.

    ``pos`` counts a feed's entries by the documents' time, then path, then
    place in the document; it depends on the landed files alone.
    """
    found = _entries(spark.read, path)
    files = found.groupBy("feed_id", "_file").agg(F.min("_time").alias("_time"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("feed_id").orderBy("_time", "_file")) - F.col("_n")
    starts = files.select("_file", earlier.alias("_earlier"))
    return _as_entries(found.join(starts, "_file").withColumn("pos", F.col("_earlier") + F.col("place")))


def read_feed_titles(spark: SparkSession, path: str) -> DataFrame:
    """(feed_id, feed_title): what the newest document of each feed calls the feed."""
    shape = T.StructType([T.StructField("title", _TEXT), _FEED])
    heads = [spark.read.format("xml").option("rowTag", tag).schema(shape).load(path).select("feed_id", "title", F.col("_metadata.file_modification_time").alias("at")) for tag in ("channel", "feed")]
    named = heads[0].unionByName(heads[1]).filter(F.coalesce(F.trim("title"), F.lit("")) != "")
    return named.groupBy("feed_id").agg(F.max_by(F.trim("title"), F.struct("at", "title")).alias("feed_title"))


def stream_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over the landing folder.

    A stream can't count what came before, so ``pos`` is made of the document's time in milliseconds and the
    place in it: it orders a feed's entries as in batch, but for documents of one feed that landed in one millisecond.
    """
    pos = F.shiftleft(F.unix_millis("_time"), PLACE_BITS) + F.col("place")
    return _as_entries(_entries(spark.readStream, path).withColumn("pos", pos))


def land_feed_documents(entries: DataFrame, path: str, atom: bool = False) -> None:
    """Write entries as RSS or Atom documents in the landing layout, beside what lies there."""
    tag, root, fields = ("entry", "feed", ENTRY.names) if atom else ("item", "channel", ITEM.names)
    columns = [F.col(f"`{name}`") for name in fields if name in entries.columns and not (atom and name == "link")]
    if atom:
        columns.append(F.array(F.struct(F.lit("self").alias("_rel"), F.lit("http://self").alias("_href")), F.struct(F.lit("alternate").alias("_rel"), F.col("link").alias("_href"))).alias("link"))
    (
        entries.select("feed_id", *columns).write.mode("append").partitionBy("feed_id")
        .format("xml").option("rowTag", tag).option("rootTag", root).save(path)
    )


def seed_feeds(feeds: DataFrame, urls: DataFrame, now, interval_minutes: int = DEFAULTS.fetch_interval_minutes) -> DataFrame:
    """Add the addresses that are not listed yet, named after their host."""
    from storyloom.operators.ids import with_new_ids
    from storyloom.operators.updates import not_stored

    missing = not_stored(urls.select("url").distinct(), feeds, ["url"])
    fresh = with_new_ids(missing, "url", feeds).select(
        "id", "url", host_name(F.col("url")).alias("name"), F.lit(interval_minutes).alias("fetch_interval_minutes"),
        F.lit(None).cast("timestamp").alias("last_fetched_at"), now_col(now).alias("created_at"), F.lit(False).alias("is_paused"),
    )
    return feeds.unionByName(fresh, allowMissingColumns=True)
