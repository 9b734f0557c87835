"""The rate limit as keyed state of a stream: each address's open window lives in the query's state store.

The live job carries open windows in a table of its own; here Spark keeps them, versioned with the query's checkpoint, so a
restart goes on where the last committed batch ended. State is kept in RocksDB on the executors' disks and written to the
checkpoint as changes, so its size is not bound by their memory.

A call of Python takes about a millisecond, and a large batch has more addresses than that allows for. Addresses are
therefore put into groups by their hash; a group's events are judged together, and its windows are one value of the state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from querytide.errors import InvalidArgumentError

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The number of groups, and the windows of a group's addresses as an Arrow stream.
STATE = "groups int, windows binary"
# `seen` is when the address was last in a batch, in milliseconds by the wall clock.
_WINDOWS = pa.schema([("ip", pa.string()), *((name, pa.int64()) for name in ("anchor", "n", "latest", "seen"))])
_GROUP = "_group_of_addresses"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
# Up to this many addresses, windows are followed one by one.
_FEW_ADDRESSES = 8


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of the session's streams in RocksDB, and write changes instead of whole snapshots.

    State with timeouts would otherwise make Spark run empty batches without end, so a stream that only works off what is
    there would never stop; addresses are forgotten along with the next batch that has messages."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


@contextmanager
def few_state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that are started for the first time within this keep their state in as many partitions as the cluster has
    cores, if that is fewer than the session's shuffle partitions.

    Every micro-batch loads, runs Python for and commits each partition, however few addresses it holds; state in RocksDB
    lies on disk and needs no partitions to fit. A checkpoint keeps the number it began with."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def judged(arrivals: np.ndarray, limit: int, ttl: int, anchor: int | None, n: int) -> tuple[np.ndarray, int, int]:
    """Verdicts of events in order of arrival, given the open window and the events in it; and the window afterwards."""
    passed = np.empty(len(arrivals), dtype=bool)
    at = 0
    while at < len(arrivals):
        if anchor is None or arrivals[at] > anchor + ttl:
            anchor, n = int(arrivals[at]), 0
        end = int(np.searchsorted(arrivals, anchor + ttl, side="right"))
        passed[at:end] = np.arange(n, n + end - at) < limit
        n, at = n + end - at, end
    return passed, anchor, n


def judged_together(
    starts: np.ndarray, arrivals: np.ndarray, limit: int, ttl: int, anchors: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """The same for several addresses, whose events lie one after the other and begin at `starts`.

    `anchors` and `counts` are changed to the windows afterwards; a count of 0 says that no window is open. Each round takes
    the next window of every address that has events left."""
    ends, at = np.append(starts[1:], len(arrivals)), starts.copy()
    times, rank = np.unique(arrivals, return_inverse=True)
    width = len(times) + 1
    place = np.repeat(np.arange(len(starts)), ends - starts) * width + rank
    passed = np.zeros(len(arrivals) + 1, dtype=np.int64)
    limit, ttl = min(limit, _MOST), min(ttl, _MOST)

    def closing(anchor: np.ndarray) -> np.ndarray:
        return np.minimum(anchor, _MOST - ttl) + ttl

    left = np.flatnonzero(at < ends)
    while len(left) > _FEW_ADDRESSES:
        first, anchor, n = at[left], anchors[left], counts[left]
        opens = (n == 0) | (arrivals[first] > closing(anchor))
        anchor, n = np.where(opens, arrivals[first], anchor), np.where(opens, 0, n)
        end = np.searchsorted(place, left * width + np.searchsorted(times, closing(anchor), side="right"))
        np.add.at(passed, first, 1)
        np.subtract.at(passed, first + np.clip(limit - n, 0, end - first), 1)
        anchors[left], counts[left], at[left] = anchor, n + end - first, end
        left = left[end < ends[left]]
    verdicts = np.cumsum(passed[:-1]) > 0
    for k in left:
        anchor = int(anchors[k]) if counts[k] else None
        verdicts[at[k] : ends[k]], anchors[k], counts[k] = judged(
            arrivals[at[k] : ends[k]], limit, ttl, anchor, int(counts[k])
        )
    return verdicts


def _ranks(column: pd.Series) -> np.ndarray:
    """Values, or numbers in their place, that sort like the column with nulls last."""
    values = column.to_numpy()
    if values.dtype != object:
        return values
    codes, found = pd.factorize(values, sort=True)
    return np.where(codes < 0, len(found), codes)


def _packed(windows: Sequence[np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(windows, _WINDOWS, strict=True)], schema=_WINDOWS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WINDOWS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState, groups: int) -> list[np.ndarray]:
    if not state.exists:
        return [np.empty(0, f.type.to_pandas_dtype()) for f in _WINDOWS]
    began_with, packed = state.get
    if began_with != groups:
        raise ValueError(f"the checkpoint began with {began_with} groups of addresses, not {groups}")
    batch = pa.ipc.open_stream(packed).read_next_batch()
    return [column.to_numpy(zero_copy_only=False) for column in batch.columns]


def _state_function(
    limit: int, ttl: int, order: Sequence[str], ip: str, arrival: str, verdict: str, forget_millis: int, groups: int
):
    def keep(windows: Sequence[np.ndarray], now: int, state: GroupState) -> None:
        """Keep the windows of the addresses that are not to be forgotten yet; come again when the next of them is."""
        kept = windows[-1] + forget_millis >= now
        if not kept.any():
            state.remove()
            return
        windows = windows if kept.all() else [values[kept] for values in windows]
        state.update((groups, _packed(windows)))
        state.setTimeoutDuration(max(1, int(windows[-1].min()) + forget_millis - now))

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, known = state.getCurrentProcessingTimeMs(), _unpacked(state, groups)
        if state.hasTimedOut:
            keep(known, now, state)
            return
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        before = len(known[0])
        codes, ips = pd.factorize(np.concatenate([known[0], rows[ip].to_numpy(dtype=object)]))
        codes, new = codes[before:], len(ips) - before
        anchors, counts, latest, seen = (
            np.concatenate([values, np.full(new, fill, dtype=np.int64)])
            for values, fill in zip(known[1:], (0, 0, _LEAST, now), strict=True)
        )
        times = rows[arrival].to_numpy()
        place = np.lexsort([*(_ranks(rows[name]) for name in reversed(order)), times, codes])
        rows, codes, times = rows.take(place), codes[place], times[place]
        present, starts = np.unique(codes, return_index=True)
        # An event that was overtaken counts as arriving with the last one before it.
        times = np.maximum(times, latest[codes])
        anchor, n = anchors[present], counts[present]
        passed = judged_together(starts, times, limit, ttl, anchor, n)
        anchors[present], counts[present], seen[present] = anchor, n, now
        latest[present] = times[np.append(starts[1:], len(times)) - 1]
        keep([ips, anchors, counts, latest, seen], now, state)
        rows.pop(_GROUP)
        yield rows.assign(**{verdict: passed})

    return run


def with_rate_verdict(
    events: DataFrame,
    limit: int,
    ttl: int,
    order: Sequence[str] = ("seq",),
    ip: str = "ip",
    arrival: str = "arrival",
    verdict: str = "rate_ok",
    forget_millis: int = 3_600_000,
    groups: int = 512,
) -> DataFrame:
    """Rate-limit a stream of events: the columns of `events` and a boolean, in append mode.

    The same verdicts as the batch operator's if the batches of the stream follow each other by arrival; an event that
    was overtaken by a later batch of its address counts as arriving with that batch's last event. Events without an
    address or arrival pass and are not shuffled. An address that sends nothing for `forget_millis` by the wall clock is
    forgotten, so that must be longer than a window, by as much as a replay may be slower than the original.

    A micro-batch's events of a group of addresses go to one task: the source's limit per batch bounds them, so bound the
    source. A group's windows are written anew when one of its addresses sends, and there are no more tasks than groups:
    for tens of millions of addresses ask for more `groups`. A checkpoint keeps the number it began with.
    """
    if limit < 1 or ttl < 1 or groups < 1:
        raise InvalidArgumentError("limit, ttl and groups must be at least 1")
    use_rocksdb(events.sparkSession)
    counted = F.coalesce((F.col(ip) != "") & F.col(arrival).isNotNull(), F.lit(False))
    out = T.StructType([*events.schema.fields, T.StructField(verdict, T.BooleanType())])
    run = _state_function(limit, ttl, tuple(order), ip, arrival, verdict, forget_millis, groups)
    grouped = events.where(counted).withColumn(_GROUP, F.pmod(F.xxhash64(ip), F.lit(groups))).groupBy(_GROUP)
    limited = grouped.applyInPandasWithState(
        run, out, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return limited.unionByName(events.where(~counted).withColumn(verdict, F.lit(True)))


# Executors get these functions with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
