"""The whole job over a table of events: filter, count, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.functions.times import bucket_start
from querytide.operators.chain import STOPLIST, chain, rate_filter
from querytide.operators.counts import live, window_snapshot
from querytide.operators.ranking import top_k
from querytide.operators.stoplist import with_stop_verdict
from querytide.settings import Settings


def reason_counts(
    labelled: DataFrame, words: DataFrame | list[str], bucket: int, time: str = "timestamp", reason: str = "drop_reason"
) -> DataFrame:
    """(drop_reason, bucket_start, query, count) of events that went through the rate limit.

    The stop list looks at the query text only, so it is applied once per counted (bucket, query) and not once per
    event. Events dropped by an earlier filter are counted per reason, without bucket and query.
    """
    kept = F.col(reason).isNull()
    counted = labelled.groupBy(
        reason,
        F.when(kept, bucket_start(F.col(time), bucket)).alias("bucket_start"),
        F.when(kept, F.col("query")).alias("query"),
    ).agg(F.count("*").alias("count"))
    checked = with_stop_verdict(counted, words, verdict="_ok")
    stopped = F.col(reason).isNull() & ~F.col("_ok")
    final = F.when(stopped, STOPLIST).otherwise(F.col(reason)).alias("drop_reason")
    return checked.select(final, "bucket_start", "query", "count")


def filtered_counts(
    events: DataFrame, words: DataFrame, settings: Settings, order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Bucket and drop counts of a table of events, by rate limit and then stop list."""
    labelled = chain(events, [rate_filter(settings.rate_limit, settings.rate_ttl, order, first=True)])
    return reason_counts(labelled, words, settings.bucket)


def trending(
    events: DataFrame,
    words: DataFrame,
    settings: Settings,
    as_of: Column | int,
    order: Sequence[str] = ("seq",),
    k: int | None = None,
) -> DataFrame:
    """The top queries of the window that ends at `as_of`."""
    limited = chain(events, [rate_filter(settings.rate_limit, settings.rate_ttl, order, first=True)])
    # The rate limit has seen every event; from here on only the window matters.
    recent = limited.where(F.col("drop_reason").isNull()).select(
        bucket_start(F.col("timestamp"), settings.bucket).alias("bucket_start"), "query"
    )
    counts = live(recent, as_of, settings.window).groupBy("query").agg(F.count("*").alias("count"))
    allowed = with_stop_verdict(counts, words).where("stop_ok")
    return top_k(allowed, k or settings.top_limit)


def top_of_counts(counts: DataFrame, settings: Settings, as_of: Column | int, k: int | None = None) -> DataFrame:
    """The same list from bucket counts that are already filtered."""
    return top_k(window_snapshot(counts, as_of, settings.window), k or settings.top_limit)


