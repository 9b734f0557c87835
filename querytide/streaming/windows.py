"""Counts of closed buckets and windows from a stream, with no event lost however the input is cut into batches.

A bucket or window is closed when the latest event time, less `lateness`, has passed its end. Every micro-batch adds its
counts per bucket to a table. For the windows, a count is a rise at the first window end that covers its bucket and a fall
after the last one. Changes that lie ahead wait in a small table, together with each query's running sum at the last
closed end; when the clock moves on, the windows closed since are written out from these and never looked at again.
An event that comes after its windows were closed adds a correction to those, and counts in the others as usual.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querytide.functions.times import as_column, bucket_start
from querytide.schema import BUCKET_COUNTS, CHANGES
from querytide.sources.countstore import CountStore
from querytide.sources.files import SharedFiles
from querytide.sources.slots import SlottedTable

# Before every bucket.
_START = -(2**40)
# Clocks of past batches that are kept.
_CLOCKS = 4


@dataclass(frozen=True)
class ClosedCounts:
    """One stream's counts, kept under `path`. `window` is a multiple of `bucket`; windows end with every bucket."""

    path: str
    window: int
    bucket: int
    lateness: int
    time: str = "timestamp"

    @property
    def counts(self) -> CountStore:
        """(bucket_start, query, count) of all events."""
        return CountStore(f"{self.path}/counts", BUCKET_COUNTS, self.window)

    @property
    def ends(self) -> CountStore:
        """The same by window end, which stands in bucket_start: closed windows and corrections to them."""
        return CountStore(f"{self.path}/windows", BUCKET_COUNTS, self.window)

    @property
    def _pending(self) -> SlottedTable:
        return SlottedTable(f"{self.path}/pending", CHANGES)

    def _clocks(self, spark: SparkSession) -> SharedFiles:
        return SharedFiles(spark, f"{self.path}/clock")

    def _clock(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int]:
        """Latest event time and last closed end after a batch."""
        text = self._clocks(spark).read(str(batch_id))
        return (None, _START) if text is None else tuple(json.loads(text))

    def closed_upto(self, spark: SparkSession) -> int:
        ids = [int(name) for name in self._clocks(spark).names()]
        return self._clock(spark, max(ids, default=-1))[1]

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**trigger).start()

    def process(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch. Repeating it rewrites the same tables."""
        spark = events.sparkSession
        before, closed = self._clock(spark, batch_id - 1)
        found = events.groupBy(bucket_start(F.col(self.time), self.bucket).alias("bucket_start"), "query")
        found = found.agg(F.count("*").alias("count"), F.max(self.time).alias("latest")).persist()
        try:
            counted = self.counts.write(found.drop("latest"), batch_id)
            newest = found.agg(F.max("latest")).first()[0]
        finally:
            found.unpersist()
        latest = max((t for t in (before, newest) if t is not None), default=None)
        upto = closed if latest is None else max(closed, (latest - self.lateness) // self.bucket * self.bucket)

        first, last = F.col("bucket_start") + self.bucket, F.col("bucket_start") + self.window
        late = counted.where(first <= closed)
        ends = F.explode(F.sequence(first, F.least(last, as_column(closed)), as_column(self.bucket)))
        corrections = late.select(ends.alias("bucket_start"), "query", "count")

        ahead = counted.where(last > closed)
        rises = ahead.select("query", F.greatest(first, as_column(closed)).alias("tick"), F.col("count").alias("delta"))
        falls = ahead.select("query", (last + self.bucket).alias("tick"), (-F.col("count")).alias("delta"))
        changes = self._pending.read(spark, batch_id - 1).unionByName(rises).unionByName(falls)
        changes = changes.groupBy("query", "tick").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        passed, pending = changes.where(F.col("tick") <= upto), changes.where(F.col("tick") > upto)
        carried = passed.groupBy("query").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        carried = carried.select("query", as_column(upto).alias("tick"), "delta")
        self._pending.write(pending.unionByName(carried), batch_id)
        self.ends.write(self._between(passed, closed, upto).unionByName(corrections), batch_id)

        clocks = self._clocks(spark)
        clocks.write(str(batch_id), json.dumps([latest, upto]))
        clocks.delete(str(batch_id - _CLOCKS))

    def _between(self, changes: DataFrame, closed: int, upto: int) -> DataFrame:
        """The windows that end after `closed` and up to `upto`, from the changes up to there."""
        in_order = Window.partitionBy("query").orderBy("tick")
        runs = changes.select(
            "query",
            F.greatest("tick", as_column(closed + self.bucket)).alias("first"),
            (F.coalesce(F.lead("tick").over(in_order), as_column(upto + self.bucket)) - self.bucket).alias("last"),
            F.sum("delta").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("count"),
        ).where("count > 0 AND first <= last")
        ends = F.explode(F.sequence("first", "last", as_column(self.bucket)))
        return runs.select(ends.alias("bucket_start"), "query", "count")

    def buckets(self, spark: SparkSession) -> DataFrame:
        """(bucket_start, query, count) of the closed buckets."""
        closed = self.counts.read(spark).where(F.col("bucket_start") <= self.closed_upto(spark) - self.bucket)
        return closed.groupBy("bucket_start", "query").agg(F.sum("count").alias("count"))

    def windows(self, spark: SparkSession, after: int | None = None) -> DataFrame:
        """(window_end, query, count) of the closed sliding windows; with `after`, of those that end later."""
        ends = self.ends.read(spark, after).groupBy(F.col("bucket_start").alias("window_end"), "query")
        return ends.agg(F.sum("count").alias("count"))

    def tidy(self, spark: SparkSession, expired: int | None = None) -> None:
        """Compact both tables, without what lies up to `expired`. Readers and the stream may go on."""
        self.counts.compact(spark, expired)
        self.ends.compact(spark, expired)
