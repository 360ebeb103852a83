"""Status changes of stories as they happen, from a stream of assignments.

A story is active from an assignment on, for a fixed time after the last one.  State is one row per open
period of a story, in RocksDB; an event-time timer stands at each period's expiry.

* ``active`` goes out in the micro-batch of the assignment that opens the period.
* ``archived`` goes out when the watermark passes the expiry.  It is final: no assignment that still
  counts can lie before the watermark.
* A later assignment opens a new period, the story's revival.
* An assignment that arrives out of order may begin a period earlier, or join two of them; what was said
  before is then taken back by the same change with ``change`` -1.  Repeated assignments change nothing.

So the sum of ``change`` by story, status and time is, at any moment, what the batch operator
``status_changes`` gives for the assignments that came so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom.settings import DEFAULTS

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = 3_600_000_000


class OpenPeriods(StatefulProcessor):
    """One story's open periods, from first to last assignment, in microseconds."""

    def __init__(self, hours: int) -> None:
        self.length = hours * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.periods = handle.getMapState("periods", "first bigint", "last bigint")

    def _timer(self, last: int) -> int:
        """The first millisecond that is not before the expiry."""
        return -(-(last + self.length) // 1000)

    def _read(self) -> dict[int, int]:
        return {int(k[0]): int(v[0]) for k, v in self.periods.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._read()
        times = sorted({int(t) for frame in rows for t in frame["micros"] if t >= 1000 * timerValues.getCurrentWatermarkInMs()})
        now = joined(sorted([*before.items(), *((t, t) for t in times)]), self.length)
        old, new = ({self._timer(last) for last in p.values()} for p in (before, now))
        for first in before.keys() - now.keys():
            self.periods.removeKey((first,))
        for first, last in now.items():
            if before.get(first) != last:
                self.periods.updateValue((first,), (last,))
        for timer in old - new:
            self.handle.deleteTimer(timer)
        for timer in new - old:
            self.handle.registerTimer(timer)
        yield changes(key[0], [("active", t, -1) for t in before.keys() - now.keys()] + [("active", t, 1) for t in now.keys() - before.keys()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        over = {first: last for first, last in self._read().items() if self._timer(last) <= at}
        for first in over:
            self.periods.removeKey((first,))
        yield changes(key[0], [("archived", last + self.length, 1) for last in over.values()])

    def close(self) -> None:
        pass


def joined(spans: list[tuple[int, int]], length: int) -> dict[int, int]:
    """Spans in order of their start, joined where the next begins before the last one's expiry."""
    out: dict[int, int] = {}
    first = None
    for start, stop in spans:
        if first is not None and start < out[first] + length:
            out[first] = max(out[first], stop)
        else:
            first = start
            out[first] = stop
    return out


def changes(story: int, rows: list[tuple[str, int, int]]) -> pd.DataFrame:
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    return pd.DataFrame({"event_id": [int(story)] * len(rows), "status": [r[0] for r in rows], "micros": [r[1] for r in rows], "change": [r[2] for r in rows]}).astype(
        {"event_id": "int64", "micros": "int64", "change": "int64", "status": "object"}
    )


def story_status(assignments: DataFrame, delay: str = "1 hour", hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    """Stream of (event_id, status, at, change) from a stream of (event_id, assigned_at)."""
    assignments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    known = assignments.where("event_id is not null and assigned_at is not null")
    rows = known.withWatermark("assigned_at", delay).select("event_id", "assigned_at", F.unix_micros("assigned_at").alias("micros"))
    said = rows.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=OpenPeriods(hours), outputStructType="event_id bigint, status string, micros bigint, change bigint", outputMode="Append", timeMode="EventTime"
    )
    return said.select("event_id", "status", F.timestamp_micros("micros").alias("at"), "change")


def net_changes(said: DataFrame) -> DataFrame:
    """What stands of the changes said so far: (event_id, status, at)."""
    return said.groupBy("event_id", "status", "at").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


def status_changes(assignments: DataFrame, until, hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    """The same from a table of all assignments: every activation, and the archivings that come not after ``until``."""
    period = F.session_window("assigned_at", f"{hours} hours")
    periods = assignments.where("event_id is not null and assigned_at is not null").groupBy("event_id", period).agg(F.count("*").alias("n"))
    said = F.array(F.struct(F.lit("active").alias("status"), F.col("session_window.start").alias("at")), F.struct(F.lit("archived").alias("status"), F.col("session_window.end").alias("at")))
    each = periods.select("event_id", F.explode(said).alias("c")).select("event_id", "c.status", "c.at")
    return each.where((F.col("status") == "active") | (F.col("at") <= F.lit(until).cast("timestamp")))
