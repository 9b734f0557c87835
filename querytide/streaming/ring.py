"""The ring of reused buckets across micro-batches: what it would hold after all messages in order of arrival.

A slot holds one generation, the counts of one bucket. An event of a newer bucket clears its slot; an event of an older
bucket counts into the generation that the slot holds. The state is one row per slot and query of the present
generations, so it is as large as the live counts and does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querytide.functions.times import as_column, slot
from querytide.operators.ring import position, slot_generations
from querytide.schema import RING
from querytide.sources.slots import SlottedTable


@dataclass(frozen=True)
class RingJob:
    """Counts a stream of events into a ring of `window / bucket` slots, kept in `path`.

    `order` gives the events of a batch their order of arrival; batches follow each other. Before its first event a slot
    holds the bucket at 0, as an empty ring does.
    """

    path: str
    window: int
    bucket: int
    order: Sequence[str] = ("seq",)
    time: str = "timestamp"

    @property
    def _counts(self) -> SlottedTable:
        return SlottedTable(f"{self.path}/ring", RING)

    def start(self, events: DataFrame, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**trigger).start()

    def process(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch. Repeating it rewrites the same table."""
        before = self._counts.read(events.sparkSession, batch_id - 1)
        held = before.groupBy("slot").agg(F.max("generation").alias("held"))
        # One row per slot; a slot that the batch does not clear takes all of the batch's events.
        opened = slot_generations(events, self.window, self.bucket, self.order, self.time)
        now = opened.join(held, "slot", "full").select(
            "slot",
            F.greatest("generation", "held", as_column(0)).alias("now"),
            F.when(F.col("generation") > F.coalesce("held", as_column(0)), F.col("opened")).alias("opened"),
        )
        placed = events.withColumn("slot", slot(F.col(self.time), self.bucket, self.window // self.bucket))
        counted = placed.join(F.broadcast(now), "slot").where(
            F.col("opened").isNull() | (position(self.order) >= F.col("opened"))
        )
        counted = counted.groupBy("slot", F.col("now").alias("generation"), "query").agg(F.count("*").alias("count"))
        still = before.join(F.broadcast(now.select("slot", F.col("now").alias("generation"))), ["slot", "generation"])
        together = still.unionByName(counted).groupBy("slot", "generation", "query")
        self._counts.write(together.agg(F.sum("count").alias("count")), batch_id)

    def snapshot(self, spark: SparkSession, as_of: Column | int) -> DataFrame:
        """Counts per query over the live slots, after the newest batch."""
        newest = self._counts.latest_batch(spark)
        rows = self._counts.read(spark, -1 if newest is None else newest)
        alive = rows.where(F.col("generation") >= as_column(as_of) - self.window)
        return alive.groupBy("query").agg(F.sum("count").alias("count"))
