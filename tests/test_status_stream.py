"""Story status from a stream: timely, and in sum that of the batch operator."""

import datetime as dt
import random

import pytest

from storyloom.session import shared_dir
from storyloom.sources import tables
from storyloom.streaming import status

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
SCHEMA = "event_id long, assigned_at timestamp"


class Feed:
    """A folder of files, one micro-batch each, and the changes said after each."""

    def __init__(self, spark):
        self.spark = spark
        self.base = tables.run_dir(shared_dir(spark), "status-test")

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self, **options):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        said = status.story_status(stream, **options)
        query = said.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(said.schema).parquet(f"{self.base}/out")


def listed(frame):
    return sorted((r.event_id, r.at, r.status) for r in frame.collect())


def test_active_at_once_archived_by_timer_revived_by_a_late_article(spark):
    feed = Feed(spark)
    feed.put([(1, T0), (1, T0 + 10 * HOUR), (None, T0), (2, None)])
    assert listed(feed.run()) == [(1, T0, "active")]
    feed.put([(2, T0 + 70 * HOUR)])  # the watermark passes the expiry of story 1
    assert listed(feed.run()) == [(1, T0, "active"), (1, T0 + 58 * HOUR, "archived"), (2, T0 + 70 * HOUR, "active")]
    feed.put([(1, T0 + 71 * HOUR), (1, T0 + 71 * HOUR)])
    assert listed(feed.run())[2] == (1, T0 + 71 * HOUR, "active")


def test_an_earlier_start_takes_the_later_one_back(spark):
    feed = Feed(spark)
    feed.put([(1, T0 + 5 * HOUR), (1, T0 + 60 * HOUR)])  # two periods, 55 hours apart
    feed.run(delay="100 hours")
    feed.put([(1, T0 + 30 * HOUR), (1, T0)])
    said = feed.run(delay="100 hours")
    assert sorted((r.at, r.change) for r in said.collect()) == [(T0, 1), (T0 + 5 * HOUR, -1), (T0 + 5 * HOUR, 1), (T0 + 60 * HOUR, -1), (T0 + 60 * HOUR, 1)]
    assert listed(status.net_changes(said)) == [(1, T0, "active")]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_sum_is_that_of_the_batch(spark, seed):
    """Shuffled within the delay, repeated, over several micro-batches."""
    rng = random.Random(seed)
    rows = sorted((T0 + rng.randrange(0, 900 * 3600) * dt.timedelta(seconds=1, microseconds=rng.randrange(999)), rng.randrange(4)) for _ in range(120))
    feed, sent = Feed(spark), []
    late = sorted(rows, key=lambda r: r[0] + rng.random() * 40 * HOUR)
    for k in range(0, len(late), 30):
        part = [(story, at) for at, story in late[k : k + 30]]
        feed.put(part + rng.sample(part, 5) + rng.sample(sent, min(len(sent), 3)))
        sent = part
    said = feed.run(delay="80 hours")
    whole = spark.createDataFrame([(story, at) for at, story in rows], SCHEMA)
    watermark = max(at for at, _ in rows) - 80 * HOUR
    watermark -= dt.timedelta(microseconds=watermark.microsecond % 1000)
    assert listed(status.net_changes(said)) == listed(status.status_changes(whole, watermark))
