"""The live job: every micro-batch is filtered, added to the live counts, and the top list is published anew."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querytide.operators.chain import ANTIFRAUD
from querytide.operators.counts import live
from querytide.operators.ratelimit import label, rate_windows, tick_counts
from querytide.operators.stoplist import short_list
from querytide.plans.trending import reason_counts, top_of_counts
from querytide.schema import BATCH_COUNTS, BUCKET_COUNTS, RATE_WINDOWS
from querytide.settings import Settings
from querytide.sources.countstore import CountStore
from querytide.sources.files import SharedFiles
from querytide.sources.messages import arrival_millis, parse
from querytide.sources.published import latest_id, publish
from querytide.sources.slots import SlottedTable
from querytide.sources.stopwords import current_version, expire_stop_words, read_stop_words

MALFORMED = "malformed"

_LOCKS: dict[str, threading.Lock] = {}
# The newest snapshot of each published list, once this driver has published one.
_NEWEST: dict[str, int] = {}
# The stop list that was used last, if it is short.
_SHORT: dict[tuple[str, int], list[str] | None] = {}
# Batches whose state is kept.
_STATES = 4

# Messages are ordered by arrival; these tell messages of one arrival apart.
_ORDER = ("partition", "offset")


def _writing(path: str) -> threading.Lock:
    """One publisher at a time: the stream and the ticker of a job run in one driver."""
    return _LOCKS.setdefault(path, threading.Lock())


@dataclass(frozen=True)
class LiveJob:
    """One stream. Its state and results are tables under `path`; the stop list may be shared with other jobs.

    `follow_arrivals` ends the window at the latest arrival instead of at the present time, which makes replays of
    old messages give the lists of their own time.
    """

    path: str
    stop_words: str
    settings: Settings = field(default_factory=Settings)
    strict: bool = False
    follow_arrivals: bool = False

    @property
    def top_path(self) -> str:
        return f"{self.path}/top"

    @property
    def counts(self) -> CountStore:
        """(drop_reason, bucket_start, query, count) of all micro-batches."""
        return CountStore(f"{self.path}/counts", BATCH_COUNTS, self.settings.window)

    @property
    def quarantine_path(self) -> str:
        return f"{self.path}/quarantine"

    @property
    def _windows(self) -> SlottedTable:
        return SlottedTable(f"{self.path}/state/windows", RATE_WINDOWS)

    def _state(self, spark: SparkSession) -> SharedFiles:
        """What is known of each of the last batches: its clock, and the version of the stop list it was counted with."""
        return SharedFiles(spark, f"{self.path}/state/batches")

    @property
    def _live(self) -> SlottedTable:
        return SlottedTable(f"{self.path}/state/live", BUCKET_COUNTS)

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """Run on a stream of messages, one micro-batch per tick unless another trigger is given."""
        seen = messages.observe("intake", F.count("*").alias("messages_read"))
        writer = seen.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(trigger or {"processingTime": f"{self.settings.tick} seconds"})).start()

    def process(self, messages: DataFrame, batch_id: int) -> None:
        """One micro-batch. Repeating it rewrites the same tables."""
        spark = messages.sparkSession
        # Of the payloads, only those that go to quarantine are looked at again.
        set_aside = F.when(F.col("bad_reason").isNotNull(), F.col("value")).alias("value")
        parsed = parse(messages, self.strict).select(set_aside, *_ORDER, "timestamp", "event", "bad_reason").persist()
        try:
            arrival = arrival_millis(F.col("timestamp"))
            first, latest, bad = parsed.agg(F.min(arrival), F.max(arrival), F.count("bad_reason")).first()
            state = self._state(spark)
            before = json.loads(state.read(str(batch_id - 1)) or '{"clock": 0}')["clock"]
            clock = max(latest or 0, before)
            # A message without a broker time counts as arriving last; it must not move the clock to the epoch.
            first = max(clock if first is None else first, before)
            # A repeated batch uses the stop list that it had when it ran first.
            again = state.read(str(batch_id))
            version = json.loads(again)["stop_version"] if again else current_version(spark, self.stop_words)
            state.write(str(batch_id), json.dumps({"clock": clock, "stop_version": version}))
            state.delete(str(batch_id - _STATES))
            if bad:
                self._set_aside(parsed, batch_id)
            words = self._words(spark, version)
            counts = self._count(spark, parsed, words, batch_id, before, (first, clock), bad)
            as_of = clock // 1000 if self.follow_arrivals else int(time.time())
            self._publish(spark, counts, batch_id, as_of)
        finally:
            parsed.unpersist()

    def tick(self, spark: SparkSession, as_of: int) -> None:
        """Publish the list as of a later time, for when no messages arrive to cause a micro-batch."""
        with _writing(self.path):
            batch_id = self._live.latest_batch(spark)
            if batch_id is not None:
                self._publish_top(self._live.read(spark, batch_id), as_of)

    def start_ticker(self, spark: SparkSession) -> StreamingQuery:
        """Publish anew at every tick, with or without messages; stop it together with the stream."""
        beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = beats.writeStream.foreachBatch(lambda rows, _: self.tick(rows.sparkSession, int(time.time())))
        return writer.trigger(processingTime=f"{self.settings.tick} seconds").start()

    def tidy(self, spark: SparkSession, as_of: int) -> None:
        """Compact the counts without buckets that are out of the window, and delete old versions of the stop list. The
        stream and readers may go on meanwhile."""
        self.counts.compact(spark, expired=as_of - self.settings.window)
        expire_stop_words(spark, self.stop_words)

    def _words(self, spark: SparkSession, version: int) -> DataFrame | list[str]:
        """The stop list of a version, which never changes: a short one is read once."""
        key = (self.stop_words, version)
        if key not in _SHORT:
            _SHORT.clear()
            _SHORT[key] = short_list(read_stop_words(spark, self.stop_words, version))
        listed = _SHORT[key]
        return read_stop_words(spark, self.stop_words, version) if listed is None else listed

    def _set_aside(self, parsed: DataFrame, batch_id: int) -> None:
        bad = parsed.where(F.col("bad_reason").isNotNull()).select("value", "bad_reason", *_ORDER)
        bad.write.mode("overwrite").parquet(f"{self.quarantine_path}/batch_id={batch_id}")

    def _count(
        self,
        spark: SparkSession,
        parsed: DataFrame,
        words: DataFrame | list[str],
        batch_id: int,
        clock: int,
        arrivals: tuple[int, int],
        bad: int,
    ) -> DataFrame:
        """Counts per (drop_reason, bucket, query).

        `clock` is the latest arrival of the earlier batches, `arrivals` the first and latest of this one, `bad` the
        number of messages without an event.
        """
        limit, ttl = self.settings.rate_limit, self.settings.rate_ttl * 1000
        # The consumer's clock never runs backwards.
        known = F.coalesce(arrival_millis(F.col("timestamp")), F.lit(arrivals[1]).cast("bigint"))
        arrival = F.greatest(known, F.lit(clock).cast("bigint"))
        events = parsed.where(F.col("bad_reason").isNull()).select("event.*", arrival.alias("arrival"), *_ORDER)

        # A window that is still open continues as a tick at its anchor.
        none = F.lit(0).cast("bigint")
        still_open = self._windows.read(spark, batch_id - 1).where(F.col("anchor") + ttl >= clock)
        opened = still_open.select(
            "ip", F.col("anchor").alias("arrival"), none.alias("n"), F.col("n").alias("carried")
        )
        ticks = tick_counts(events).unionByName(opened).groupBy("ip", "arrival")
        ticks = ticks.agg(F.sum("n").alias("n"), F.sum("carried").alias("carried"))
        # Windows that are still open began up to `ttl` before the last batch ended.
        time_range = (min(arrivals[0], clock - ttl) if clock else arrivals[0], arrivals[1])
        windows = rate_windows(ticks, limit, ttl, lambda found: self._windows.write(found, batch_id), time_range)

        labelled = label(events, windows, limit, ttl, _ORDER).select(
            F.when(~F.col("rate_ok"), ANTIFRAUD).alias("drop_reason"), "timestamp", "query"
        )
        counts = reason_counts(labelled, words, self.settings.bucket)
        if bad:
            counts = counts.unionByName(
                spark.range(1).select(
                    F.lit(MALFORMED).alias("drop_reason"),
                    F.lit(None).cast("bigint").alias("bucket_start"),
                    F.lit(None).cast("string").alias("query"),
                    F.lit(bad).cast("bigint").alias("count"),
                )
            )
        return self.counts.write(counts, batch_id)

    def _publish(self, spark: SparkSession, counts: DataFrame, batch_id: int, as_of: int) -> None:
        added = counts.where(F.col("drop_reason").isNull()).drop("drop_reason")
        rows = self._live.read(spark, batch_id - 1).unionByName(added)
        merged = live(rows, as_of, self.settings.window).groupBy("bucket_start", "query")
        with _writing(self.path):
            self._publish_top(self._live.write(merged.agg(F.sum("count").alias("count")), batch_id), as_of)

    def _publish_top(self, counts: DataFrame, as_of: int) -> None:
        """Publish under an id above all others, so that the newest snapshot is never written over."""
        top = top_of_counts(counts, self.settings, as_of)
        newest = _NEWEST.get(self.top_path)
        if newest is None:
            newest = latest_id(counts.sparkSession, self.top_path)
        snapshot = 0 if newest is None else newest + 1
        publish(top, self.top_path, snapshot, F.timestamp_seconds(F.lit(as_of)))
        _NEWEST[self.top_path] = snapshot
