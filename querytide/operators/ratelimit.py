"""Rate limit per address, with a fixed window anchored at its first event.

An address's first event opens a window and passes. Events up to `ttl` after the anchor belong to the window, the
first `limit` of them pass. The first event later than that opens the next window. Whether an event opens a window
depends on all earlier events of the address, so the anchors form a chain. The chain is found in pieces:

1. `suspects` keeps the addresses that could exceed the limit at all; nobody else's events are looked at again.
2. `tick_counts` collapses their events to one row per (address, arrival).
3. Ticks are sorted by address and arrival into partitions of about equal size, whoever's they are. For the addresses
   at a partition's edges `boundary_maps` gives a function from the anchor that the partition begins with to the one it
   ends with. The functions are composed in a tree over the partitions, and the anchors are handed down the same tree,
   in as many steps as the tree is high. `placed` then fills in the anchors inside every partition.
4. `rate_windows` sums up each window and notes the arrival at which the limit is reached.

No step needs all events of an address in one task, however they lie in time: an address with all of the events is cut
like any other rows, and a group of the tree holds FAN functions of at most ttl + 2 numbers. The windows that reach the
limit are written to the shared folder; there are at most 1/limit as many as events. Events are then joined to them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.errors import InvalidArgumentError
from querytide.functions.anchors import NEVER, boundary_maps, composed, handed_down, placed
from querytide.functions.times import cell
from querytide.operators.ranking import first_k_per_group
from querytide.session import stored

# Neighbouring functions that one task of the tree composes.
FAN = 64
# Up to this many windows' length, an address's ticks are not cut.
_FEW_WINDOWS = 16


def tick_counts(events: DataFrame, ip: str = "ip", arrival: str = "arrival") -> DataFrame:
    """Events per (ip, arrival), without events that have no address. `carried` is 0 here, see `rate_windows`."""
    return (
        events.where((F.col(ip) != "") & F.col(arrival).isNotNull())
        .groupBy(F.col(ip).alias("ip"), F.col(arrival).alias("arrival"))
        .agg(F.count("*").alias("n"))
        .withColumn("carried", F.lit(0).cast("bigint"))
    )


def suspects(events: DataFrame, limit: int, ttl: int, ip: str = "ip", arrival: str = "arrival") -> DataFrame:
    """Addresses with more than half of `limit` events in some cell of a window's length.

    A window touches at most two such cells, so an address without such a cell never exceeds the limit.
    """
    cells = events.where(F.col(ip) != "").groupBy(F.col(ip).alias("ip"), cell(F.col(arrival), ttl + 1).alias("cell"))
    return cells.agg(F.count("*").alias("n")).where(F.col("n") * 2 > limit).select("ip").distinct()


_ANCHORED = "ip string, arrival bigint, n bigint, carried bigint, anchor bigint"
_MAP = "ip string, node bigint, first bigint, last bigint, entries array<bigint>, exits array<bigint>"


def _incoming(maps: DataFrame, ttl: int, parts: int) -> dict[int, int]:
    """For each partition that goes on with an address of the one before it: the anchor it begins with.

    Maps are composed FAN by FAN until FAN or fewer nodes are left; then the anchors come down again. There are at most
    two maps and one anchor a partition.
    """
    levels, nodes = [maps], parts
    above = F.call_function("div", F.col("node"), F.lit(FAN).cast("bigint")).alias("parent")
    while nodes > FAN:
        grown = levels[-1].select("*", above).groupBy("ip", "parent").applyInPandas(composed(ttl), _MAP)
        levels.append(stored(grown, "rate-maps"))
        nodes = -(-nodes // FAN)
    known = None
    for level in reversed(levels):
        rows = level.select("*", above)
        if known is None:
            rows = rows.withColumn("incoming", F.lit(NEVER).cast("bigint"))
        else:
            rows = rows.join(known.withColumnRenamed("node", "parent"), ["ip", "parent"])
        known = rows.groupBy("ip", "parent").applyInPandas(handed_down(ttl), "ip string, node bigint, incoming bigint")
    return {row.node: row.incoming for row in known.where(F.col("incoming") != NEVER).collect()}


def _anchored_by_maps(ticks: DataFrame, ttl: int) -> DataFrame:
    """(ip, arrival, n, carried, anchor): every tick with the anchor of its window.

    `ticks` are sorted by address and arrival; their column part numbers the partitions in that order."""
    maps = stored(ticks.mapInPandas(boundary_maps(ttl), _MAP), "rate-maps")
    last = maps.agg(F.max("node")).first()[0]
    incoming = {} if last is None else _incoming(maps, ttl, last + 1)
    return ticks.mapInPandas(placed(ttl, incoming), _ANCHORED)


def _anchored_by_address(ticks: DataFrame, ttl: int) -> DataFrame:
    """The same for ticks that lie within a few windows' length: an address has few enough to be sorted in one task."""
    by_address = ticks.withColumn("part", F.lit(0)).repartition("ip").sortWithinPartitions("ip", "arrival")
    return by_address.mapInPandas(placed(ttl, {}), _ANCHORED)


def _summed(anchored: DataFrame, limit: int) -> DataFrame:
    in_window = Window.partitionBy("ip", "anchor").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("n") + F.col("carried")
    keep = F.greatest(F.lit(limit) - (F.col("seen") - F.col("n")), F.lit(0)).alias("keep")
    seen = anchored.withColumn("seen", F.sum(total).over(in_window))
    return seen.groupBy("ip", "anchor").agg(
        F.sum(total).alias("n"),
        F.min(F.when(F.col("seen") > limit, F.struct("arrival", keep))).alias("cut"),
    )


def rate_windows(
    ticks: DataFrame,
    limit: int,
    ttl: int,
    store: Callable[[DataFrame], DataFrame],
    time_range: tuple[int, int] | None = None,
) -> DataFrame:
    """(ip, anchor, n, cut): every window, its events, and where it reaches the limit, as kept by `store`.

    `cut` is null while the limit holds. Otherwise `cut.arrival` is the first arrival with an event over the limit,
    and the first `cut.keep` events of that arrival still pass. `carried` counts events that were already let through
    or dropped before this table begins; they come first within their arrival. `time_range` holds the first and the
    last arrival where the caller knows them; a range of a few windows needs no maps.
    """
    if time_range is not None and (time_range[1] - time_range[0]) // (ttl + 1) < _FEW_WINDOWS:
        return store(_summed(_anchored_by_address(ticks, ttl), limit))
    parts = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = ticks.repartitionByRange(parts, "ip", "arrival").sortWithinPartitions("ip", "arrival")
    in_order = in_order.withColumn("part", F.spark_partition_id())
    # Read twice, before and after the chain is known.
    in_order.persist()
    try:
        return store(_summed(_anchored_by_maps(in_order, ttl), limit))
    finally:
        in_order.unpersist()


def blocks(
    events: DataFrame, windows: DataFrame, limit: int, ttl: int, order: Sequence[str], ip: str, arrival: str
) -> DataFrame:
    """(_ip, _cell, _from, _until, _last): the stretch of each window in which events are dropped.

    One row for each of the at most two cells the stretch touches. `_last` is the position of the last event that
    passes at `_from`; null if none does. `windows` must be a stored table.
    """
    cut = windows.where(F.col("cut").isNotNull()).select(
        F.col("ip").alias("_ip"),
        F.col("cut.arrival").alias("_from"),
        (F.col("anchor") + ttl).alias("_until"),
        F.col("cut.keep").alias("_keep"),
    )
    position = F.struct(*order)
    shared = cut.where(F.col("_keep") > 0)
    if shared.isEmpty():
        nothing = events.select(position.alias("_last")).schema["_last"].dataType
        ends = cut.withColumn("_last", F.lit(None).cast(nothing))
    else:
        # Several events share the arrival at which the limit is reached: find the last one that passes.
        at_cut = events.select(F.col(ip).alias("_ip"), F.col(arrival).alias("_from"), position.alias("_last")).join(
            shared.select("_ip", "_from", "_keep"), ["_ip", "_from"]
        )
        ranked = first_k_per_group(at_cut, ["_ip", "_from"], [F.asc("_last")], limit, spread=["_last"])
        last = ranked.where(F.col("rank") == F.col("_keep")).select("_ip", "_from", "_last")
        ends = cut.join(last, ["_ip", "_from"], "left")
        ends = stored(ends, "rate-cuts")
    cells = F.array_distinct(F.array(cell(F.col("_from"), ttl + 1), cell(F.col("_until"), ttl + 1)))
    return ends.select("_ip", F.explode(cells).alias("_cell"), "_from", "_until", "_last")


def label(
    events: DataFrame,
    windows: DataFrame,
    limit: int,
    ttl: int,
    order: Sequence[str] = ("seq",),
    ip: str = "ip",
    arrival: str = "arrival",
    verdict: str = "rate_ok",
    among: Column | None = None,
) -> DataFrame:
    """Add a boolean column: false for events over the limit of their window. `windows` must be a stored table."""
    counted = events if among is None else events.where(among)
    cut = blocks(counted, windows, limit, ttl, order, ip, arrival)
    at = F.col(arrival)
    inside = (
        (F.col(ip) == F.col("_ip"))
        & (cell(at, ttl + 1) == F.col("_cell"))
        & (at >= F.col("_from"))
        & (at <= F.col("_until"))
    )
    joined = events.join(cut, inside, "left")
    still_passes = (at == F.col("_from")) & (F.struct(*order) <= F.col("_last"))
    passed = F.col("_ip").isNull() | F.coalesce(still_passes, F.lit(False))
    if among is not None:
        passed = passed | ~F.coalesce(among, F.lit(False))
    return joined.withColumn(verdict, passed).drop("_ip", "_cell", "_from", "_until", "_last")


def with_rate_verdict(
    events: DataFrame,
    limit: int,
    ttl: int,
    order: Sequence[str] = ("seq",),
    ip: str = "ip",
    arrival: str = "arrival",
    verdict: str = "rate_ok",
    among: Column | None = None,
) -> DataFrame:
    """Rate-limit a table of events.

    `arrival` is a whole-number clock in the unit of `ttl`; `order` tells events of one arrival apart. Events with an
    empty address pass and count for nothing, as do events outside `among`. The windows that reach the limit are
    computed and written at once; the labelled events themselves are as lazy as any other DataFrame.
    """
    if limit < 1 or ttl < 1:
        raise InvalidArgumentError("limit and ttl must be at least 1")
    counted = events if among is None else events.where(among)
    suspected = stored(suspects(counted, limit, ttl, ip, arrival), "rate-suspects")
    if suspected.isEmpty():
        return events.withColumn(verdict, F.lit(True))
    ticks = tick_counts(counted.join(suspected.withColumnRenamed("ip", ip), ip, "left_semi"), ip, arrival)
    reached = rate_windows(
        ticks, limit, ttl, lambda windows: stored(windows.where(F.col("cut").isNotNull()), "rate-windows")
    )
    return label(events, reached, limit, ttl, order, ip, arrival, verdict, among)
