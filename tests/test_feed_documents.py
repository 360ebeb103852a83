"""Places of entries: from the document alone, the same order in batch and stream."""

import os

from storyloom.session import shared_dir
from storyloom.sources import feeds, tables
from storyloom.streaming.streams import run_into_files


def rss(*titles, root="rss"):
    items = "".join(f"<item><title>{t}</title><link>http://a/{t}</link></item>" for t in titles)
    return f"<rss><channel><title>c</title>{items}</channel></rss>" if root == "rss" else f"<rdf:RDF xmlns:rdf='x'><channel><title>c</title></channel>{items}</rdf:RDF>"


def atom(*titles):
    return "<feed>" + "".join(f"<entry><title>{t}</title><link href='http://a/{t}'/></entry>" for t in titles) + "</feed>"


def land(folder, documents):
    for feed, name, at, text in documents:
        path = folder / f"feed_id={feed}"
        path.mkdir(exist_ok=True)
        (path / name).write_text(text)
        os.utime(path / name, (at, at))


def test_batch_and_stream_order_alike(spark, tmp_path):
    many = [f"m{n}" for n in range(3000)]
    land(tmp_path, [
        (1, "b.xml", 1000, rss("one", "two", "three")), (1, "a.xml", 2000, atom("four", "five")), (1, "c.xml", 1500, rss("mid", root="rdf")),
        (2, "x.xml", 1000, rss(*many)), (3, "bad.xml", 1000, "<rss><channel><item>"), (3, "empty.xml", 1000, ""), (4, "none.xml", 1000, rss()),
    ])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a document of many splits, if it could be split
    try:
        rows = feeds.read_feed_entries(spark, str(tmp_path)).collect()
        said = run_into_files(feeds.stream_feed_entries(spark, str(tmp_path)), "places").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    listed = lambda rows, feed: [r.title for r in sorted(rows, key=lambda r: r.pos) if r.feed_id == feed]
    assert listed(rows, 1) == ["one", "two", "three", "mid", "four", "five"] and listed(rows, 2) == many
    assert [r.pos for r in sorted(rows, key=lambda r: r.pos) if r.feed_id == 2] == list(range(3000))
    for feed in (1, 2, 3, 4):
        assert listed(said, feed) == listed(rows, feed)
    assert len({(r.feed_id, r.pos) for r in said}) == len(said)


def test_landed_documents_come_back(spark):
    path = tables.run_dir(shared_dir(spark), "landing")
    entries = spark.createDataFrame([(1, "t & <b>", "http://x/1"), (2, "u", None)], "feed_id long, title string, link string")
    feeds.land_feed_documents(entries, path)
    assert sorted((r.feed_id, r.pos, r.title, r.link) for r in feeds.read_feed_entries(spark, path).collect()) == [(1, 0, "t & <b>", "http://x/1"), (2, 0, "u", None)]
