"""Query counts per bucket and per window, and drop counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.times import as_column, bucket_start


def bucket_counts(events: DataFrame, bucket: int, time: str = "timestamp") -> DataFrame:
    """Events per (bucket_start, query). The query text is the key as sent.

    Partial aggregation absorbs a hot query before the shuffle.
    """
    return events.groupBy(bucket_start(F.col(time), bucket).alias("bucket_start"), "query").agg(
        F.count("*").alias("count")
    )


def live(rows: DataFrame, as_of: Column | int, window: int, until: Column | int | None = None) -> DataFrame:
    """Rows whose bucket is live at `as_of`: the last `window` seconds, in whole buckets.

    `until` also cuts off buckets that lie after it; without it a future bucket counts at once.
    """
    kept = rows.where(F.col("bucket_start") > as_column(as_of) - window)
    return kept if until is None else kept.where(F.col("bucket_start") <= as_column(until))


def window_snapshot(
    counts: DataFrame, as_of: Column | int, window: int, until: Column | int | None = None
) -> DataFrame:
    """Live counts per query, from bucket counts."""
    return live(counts, as_of, window, until).groupBy("query").agg(F.sum("count").alias("count"))


def snapshot_of_events(
    events: DataFrame,
    as_of: Column | int,
    window: int,
    bucket: int,
    until: Column | int | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """The same snapshot straight from events, in one aggregation.

    The bare time predicate is implied by the bucket predicate; it is stated because it reaches the Parquet scan.
    """
    recent = events.where(F.col(time) > as_column(as_of) - window)
    if until is not None:
        recent = recent.where(F.col(time) < as_column(until) + bucket)
    buckets = recent.select(bucket_start(F.col(time), bucket).alias("bucket_start"), "query")
    return live(buckets, as_of, window, until).groupBy("query").agg(F.count("*").alias("count"))


def messages_read(messages: DataFrame) -> DataFrame:
    """Number of messages, counted before decoding and filtering."""
    return messages.agg(F.count("*").alias("messages_read"))


def drop_counts(labelled: DataFrame, count: Column | None = None) -> DataFrame:
    """Dropped events per reason. `count` is the weight of a row when rows are already counted."""
    weight = F.count("*") if count is None else F.sum(count)
    return labelled.where(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(weight.alias("dropped"))


def drop_rate(labelled: DataFrame) -> DataFrame:
    """Messages, dropped messages and their share."""
    dropped = F.count("drop_reason")
    return labelled.agg(
        F.count("*").alias("messages_read"),
        dropped.alias("dropped"),
        (dropped / F.count("*")).alias("share_dropped"),
    )
