"""Rows of a table that hold a whole vector, and scoring a stated set of them against all rows in blocks.

The stated rows are dealt into blocks and all rows into slices by hashes of their ids. Every (block, slice) cell is
one run of a task: the block's rows arrive first and are kept, the slice's rows stream past in Arrow batches. So a
task holds one block, whatever the size of the table, nothing is broadcast, and a lost executor costs its cells only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a slice at most.
MOST_ROWS = 1 << 20
#: Where there are fewer cells than tasks could run, blocks and then slices are made smaller, down to this many rows.
LEAST_ASKED = 64
LEAST_ROWS = 4096


class Worker(Protocol):
    """What a cell does: made from the block's rows, shown the slice's rows, asked for the result."""

    def scan(self, rows: pa.RecordBatch) -> None: ...

    def result(self) -> pa.RecordBatch: ...


def is_whole(vector: Column) -> Column:
    """True for a vector with components that are all there and finite."""
    there = F.size(F.array_compact(vector)) == F.size(vector)
    # NaN counts as greater than every number.
    finite = (F.array_max(vector) < float("inf")) & (F.array_min(vector) > float("-inf"))
    return F.coalesce((F.size(vector) > 0) & there & finite, F.lit(False))


def one_per_id(rows: DataFrame, id_col: str) -> DataFrame:
    """Of rows with the same id, the one that is smallest in the other columns. Rows without an id are left out."""
    others = F.struct(*[c for c in rows.columns if c != id_col])
    return rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(others).alias("_one")).select(id_col, "_one.*")


def in_cells(
    asked: DataFrame,
    rows: DataFrame,
    sizes: tuple[int, int],
    block_rows: int,
    make: Callable[[pa.Table], Worker],
    schema: str,
) -> DataFrame:
    """Run `make(block).scan(slice)` for every block of `asked` and every slice of `rows`, and return the results.

    Both tables have a long column `id` and otherwise the same columns; `sizes` are their row counts.
    """
    n_asked, n_rows = sizes
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_asked // block_rows), min(wanted, n_asked // LEAST_ASKED))
    slices = max(1, -(-n_rows // MOST_ROWS), min(-(-wanted // blocks), n_rows // LEAST_ROWS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    columns = rows.columns
    left = asked.select(dealt(blocks, 0).alias("_block"), "*").select("_block", every(slices).alias("_slice"), F.lit(0).alias("_side"), *columns)
    right = rows.select(dealt(slices, 1).alias("_slice"), "*").select(every(blocks).alias("_block"), "_slice", F.lit(1).alias("_side"), *columns)
    cell = F.col("_block") * slices + F.col("_slice")
    both = left.unionByName(right).repartitionById(blocks * slices, cell.cast("int"))
    return both.sortWithinPartitions("_block", "_slice", "_side", "id").mapInArrow(_runs(make), schema)


def _runs(make: Callable[[pa.Table], Worker]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, worker = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(edges, edges[1:]):
                here, side = tuple(marks[:2, at]), marks[2, at]
                if here != key:
                    if worker is not None:
                        yield worker.result()
                    key, block, worker = here, [], None
                part = batch.slice(at, end - at)
                if side == 0:
                    block.append(part)
                elif block:
                    worker = worker or make(pa.Table.from_batches(block))
                    worker.scan(part)
        if worker is not None:
            yield worker.result()

    return run


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def first_of_each(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k entries of every key, by falling score and rising id."""
    order = np.lexsort((ids, -scores, keys))
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]
