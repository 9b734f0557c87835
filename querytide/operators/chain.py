"""Filters in sequence: the first one an event fails names its drop reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.operators.ratelimit import with_rate_verdict
from querytide.operators.stoplist import with_stop_verdict

# A filter is a condition (true = pass), or a function that adds a boolean column to the rows it is given:
# (rows, column that marks the rows still in, name of the column to add) -> rows.
Verdict = Callable[[DataFrame, Column, str], DataFrame]
Filter = tuple[str, Column | Verdict]

ANTIFRAUD = "antifraud"
STOPLIST = "stoplist"


def chain(events: DataFrame, filters: Sequence[Filter], reason: str = "drop_reason") -> DataFrame:
    """Add the reason of the first failed filter; null for events that pass all of them.

    Each filter sees only what the earlier ones let through, which matters for filters that count.
    """
    labelled = events.withColumn(reason, F.lit(None).cast("string"))
    for name, test in filters:
        alive = F.col(reason).isNull()
        if isinstance(test, Column):
            labelled = labelled.withColumn("_ok", test)
        else:
            labelled = test(labelled, alive, "_ok")
        failed = alive & ~F.coalesce(F.col("_ok"), F.lit(False))
        labelled = labelled.withColumn(reason, F.when(failed, F.lit(name)).otherwise(F.col(reason))).drop("_ok")
    return labelled


def rate_filter(limit: int, ttl: int, order: Sequence[str] = ("seq",), first: bool = False) -> Filter:
    """Anti-fraud. `first` says that no filter comes before it, so that all rows count."""

    def verdict(rows: DataFrame, alive: Column, out: str) -> DataFrame:
        return with_rate_verdict(rows, limit, ttl, order, verdict=out, among=None if first else alive)

    return ANTIFRAUD, verdict


def stop_filter(words: DataFrame) -> Filter:
    def verdict(rows: DataFrame, alive: Column, out: str) -> DataFrame:
        return with_stop_verdict(rows, words, verdict=out)

    return STOPLIST, verdict


def standard_chain(events: DataFrame, words: DataFrame, limit: int, ttl: int, order: Sequence[str] = ("seq",)):
    """Anti-fraud, then stop list: a stop-listed event still uses up its address's allowance."""
    return chain(events, [rate_filter(limit, ttl, order, first=True), stop_filter(words)])


def kept(labelled: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return labelled.where(F.col(reason).isNull()).drop(reason)
