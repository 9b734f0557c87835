"""Ring-exact snapshot: what a ring of reused buckets would hold after all events arrived in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.times import as_column, bucket_start, slot

# Above this many slots the slot table is joined without a broadcast hint.
_BROADCAST_SLOTS = 65_536


def position(order: Sequence[str]) -> Column:
    """What tells the order of arrival; a single column stays a plain one, which aggregates without sorting."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def slot_generations(
    events: DataFrame,
    window: int,
    bucket: int,
    order: Sequence[str] = ("seq",),
    time: str = "timestamp",
    since: Column | int | None = None,
) -> DataFrame:
    """One row per slot: its last bucket, and the arrival position of the event that opened that bucket. With `since`,
    slots whose last bucket is older have no row, and older events are not looked at.

    A newer bucket clears its slot and an older one never does, so the last generation of a slot is its greatest
    bucket and begins with the first arrival in that bucket. Two small aggregations replace a running maximum over
    each slot, which would send a slot's whole history to one task.
    """
    slots = window // bucket
    start = bucket_start(F.col(time), bucket)
    if since is not None:
        # The first condition is implied by the second; it reaches the Parquet scan.
        events = events.where((F.col(time) >= as_column(since)) & (start >= as_column(since)))
    opened = events.groupBy(slot(F.col(time), bucket, slots).alias("slot"), start.alias("bucket_start")).agg(
        F.min(position(order)).alias("opened")
    )
    return opened.groupBy("slot").agg(
        F.max("bucket_start").alias("generation"), F.max_by("opened", "bucket_start").alias("opened")
    )


def ring_snapshot(
    events: DataFrame,
    as_of: Column | int,
    window: int,
    bucket: int,
    order: Sequence[str] = ("seq",),
    time: str = "timestamp",
) -> DataFrame:
    """Counts per query over the last generation of every live slot.

    A late event whose slot already holds a newer bucket is counted as if current, a future event counts at once and
    clears the slot. `order` must give events a total arrival order.
    """
    slots = window // bucket
    held = slot_generations(events, window, bucket, order, time, as_column(as_of) - window)
    if slots <= _BROADCAST_SLOTS:
        held = F.broadcast(held)
    placed = events.withColumn("slot", slot(F.col(time), bucket, slots))
    return (
        placed.join(held, "slot")
        .where(position(order) >= F.col("opened"))
        .groupBy("query")
        .agg(F.count("*").alias("count"))
    )
