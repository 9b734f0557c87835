"""Counts of a sliding window at every step, and the top list of every tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querytide.functions.times import as_column, ceil_to, cell
from querytide.operators.ranking import first_k_per_group, top_order

# Length of a time chunk, in windows. It bounds the rows of one (query, chunk) group.
_WINDOWS_PER_CHUNK = 16
# Spells of time in a window for which a top list's lowest count is estimated.
_SPELLS_PER_WINDOW = 8


def _chunk_span(window: int, step: int) -> int:
    return step * -(-_WINDOWS_PER_CHUNK * window // step)


def window_runs(counts: DataFrame, window: int, step: int) -> DataFrame:
    """(chunk, query, tick, next_tick, count): the stretches of ticks in which a query's window count stays the same.

    A bucket is live at tick t iff bucket_start <= t < bucket_start + window. Each bucket count becomes a rise and a
    fall; their running sum is the window count. Only those two changes are shuffled, not one row per tick.
    Running sums restart in every chunk of time: a count that is still live at a chunk's start is carried there as a
    rise, so no query's whole history lands in one group.
    """
    span = _chunk_span(window, step)
    start, n = F.col("bucket_start"), F.col("count")
    rise, fall = ceil_to(start, step), ceil_to(start + window, step)

    def change(chunk, tick, delta):
        return F.struct(chunk.alias("chunk"), tick.alias("tick"), delta.alias("delta"))

    rise_chunk, fall_chunk = cell(rise, span), cell(fall, span)
    changes = F.when(
        rise_chunk == fall_chunk, F.array(change(rise_chunk, rise, n), change(fall_chunk, fall, -n))
    ).otherwise(
        F.array(
            change(rise_chunk, rise, n),
            change(fall_chunk, fall_chunk * span, n),
            change(fall_chunk, fall, -n),
        )
    )
    deltas = (
        counts.where(rise < fall)
        .select("query", F.explode(changes).alias("change"))
        .groupBy("query", "change.chunk", "change.tick")
        .agg(F.sum("change.delta").alias("delta"))
    )
    in_chunk = Window.partitionBy("query", "chunk").orderBy("tick")
    return deltas.select(
        "chunk",
        "query",
        "tick",
        F.coalesce(F.lead("tick").over(in_chunk), (F.col("chunk") + 1) * span).alias("next_tick"),
        F.sum("delta").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)).alias("count"),
    ).where("count > 0")


def _at_ticks(runs: DataFrame, step: int) -> DataFrame:
    ticks = F.sequence("tick", F.col("next_tick") - step, as_column(step))
    return runs.select(F.explode(ticks).alias("tick"), "query", "count")


def sliding_counts(counts: DataFrame, window: int, step: int) -> DataFrame:
    """(tick, query, count) for every multiple of `step` at which the query's window is not empty."""
    return _at_ticks(window_runs(counts, window, step), step)


def _contenders(runs: DataFrame, window: int, step: int, k: int) -> DataFrame:
    """Runs that may be among the first k at one of their ticks, cut at the ends of short spells of time.

    In a spell, a query that is there throughout has at least its least count at every tick. The k-th largest of these is
    therefore a count that k queries reach at every tick of the spell, and a run below it is in no top list. Spells lie
    within chunks, so the least counts need no shuffle beyond that of the runs; the bound is one row a spell.
    """
    per_chunk = _chunk_span(window, step) // step
    ticks = next(n for n in range(max(1, window // step // _SPELLS_PER_WINDOW), 0, -1) if per_chunk % n == 0)
    spell = ticks * step
    spells = F.sequence(cell(F.col("tick"), spell), cell(F.col("next_tick") - step, spell))
    cut = runs.select("chunk", "query", "tick", "next_tick", "count", F.explode(spells).alias("spell"))
    begin = F.col("spell") * spell
    cut = cut.select(
        "chunk",
        "spell",
        "query",
        F.greatest("tick", begin).alias("tick"),
        F.least("next_tick", begin + spell).alias("next_tick"),
        "count",
    )
    least = cut.groupBy("query", "chunk", "spell").agg(
        F.sum(F.col("next_tick") - F.col("tick")).alias("covered"), F.min("count").alias("count")
    )
    lasting = least.where(F.col("covered") == spell).select("spell", "query", "count")
    bound = first_k_per_group(lasting, ["spell"], [F.desc("count")], k, spread=["query"]).where(F.col("rank") == k)
    bound = bound.select("spell", F.col("count").alias("reached"))
    kept = cut.join(bound, "spell", "left").where(F.col("count") >= F.coalesce("reached", as_column(0)))
    return kept.select("query", "tick", "next_tick", "count")


def tick_top(counts: DataFrame, window: int, bucket: int, tick: int, k: int) -> DataFrame:
    """(tick, rank, query, count): the top k at every tick.

    With whole buckets the answer changes at bucket starts only, so ticks finer than a bucket are ranked once per
    bucket and repeated afterwards. Counts are followed from tick to tick only for queries that can be in the list.
    """
    step = bucket if bucket % tick == 0 else tick
    series = _at_ticks(_contenders(window_runs(counts, window, step), window, step, k), step)
    ranked = first_k_per_group(series, ["tick"], top_order(), k, spread=["query"])
    if step != tick:
        repeats = F.sequence("tick", F.col("tick") + (step - tick), as_column(tick))
        ranked = ranked.withColumn("tick", F.explode(repeats))
    return ranked.select("tick", F.col("rank").cast("bigint").alias("rank"), "query", "count")
