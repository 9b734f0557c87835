"""Nearest neighbours by counting collisions on single projections.

Every vector has one number on each of `PROJECTIONS` random directions, and a direction's numbers are kept as a sorted
array. A query's window on it is centred at the query's own number and widened step by step, which is a
rehash with wider buckets without another table. A vector within distance r of the query lies in a window of
half-width z * r with a known probability, so it is found in a known share of the windows: vectors that collide at
least so often, less a few standard deviations, are verified with the exact measure. The window is wide enough
when it covers the distance of the k-th nearest vector found so far.

The measure is the inner product. With M the largest length, a vector x gets the further component
sqrt(M^2 - |x|^2) and a query 0; the distance between them then falls as the inner product rises.

The work is done in cells of `vector_blocks`: a cell's sorted arrays cover `CHUNK` rows at a time, so memory does not grow
with the table, every row is indexed, and what a query has found in earlier chunks narrows its windows in later ones.
Nothing is fitted but the largest length. MISS bounds how often a vector just at the k-th distance is overlooked; the
tests measure the share of true neighbours that is found.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.llm.vector_blocks import in_cells, is_whole, matrix, one_per_id
from querytide.session import stored

PROJECTIONS = 64
#: Half-width of a window as a multiple of the distance it has to cover.
HALF_WIDTH = 1.3
#: A vector may collide this many standard deviations less often than expected.
SLACK = 1.2
#: Factor from one window to the next wider one.
WIDER = 1.5
#: Queries of a cell, and rows of one set of sorted arrays.
QUERIES = 1024
CHUNK = 10_240
FIRST = 1024


def directions(dims: int, count: int = PROJECTIONS, seed: int = 12) -> np.ndarray:
    """(dims, count) directions of length sqrt(dims), in sets that are orthogonal: a difference of length r has
    projections that vary by r, and those of one set share out its length among them."""
    draw = np.random.default_rng(seed)
    sets = [np.linalg.qr(draw.standard_normal((dims, dims)))[0] for _ in range(-(-count // dims))]
    return np.concatenate(sets, axis=1)[:, :count] * np.sqrt(dims)


def share_inside(dims: int, half_width: float = HALF_WIDTH) -> float:
    """How often a vector at distance 1 lies in a window: the cosine t of a random angle has the density
    (1 - t^2)^((dims - 3) / 2), integrated here over the angle."""
    angles = (np.arange(100_000) + 0.5) * (np.pi / 200_000)
    weights = np.sin(angles) ** (dims - 2)
    return float(weights[np.cos(angles) * np.sqrt(dims) <= half_width].sum() / weights.sum())


def threshold(dims: int, count: int = PROJECTIONS, half_width: float = HALF_WIDTH, slack: float = SLACK) -> int:
    """Collisions that make a vector a candidate."""
    share = share_inside(dims, half_width)
    return max(1, int(np.ceil(count * share - slack * np.sqrt(count * share * (1 - share)))))


class SortedArrays:
    """The projections of some rows: one sorted array a direction, and which row each place belongs to."""

    def __init__(self, projected: np.ndarray) -> None:
        numbers = np.ascontiguousarray(projected.T)
        self.order = np.argsort(numbers, axis=1)
        self.sorted = np.take_along_axis(numbers, self.order, axis=1)
        self.rows = projected.shape[0]

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, directions) first and last places of the windows."""
        low, high = np.empty(centres.shape, np.intp), np.empty(centres.shape, np.intp)
        for k, line in enumerate(self.sorted):
            low[:, k] = np.searchsorted(line, centres[:, k] - half, side="left")
            high[:, k] = np.searchsorted(line, centres[:, k] + half, side="right")
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of every row with one query, counted inside its windows or outside, whichever is less."""
        inside = high - low
        wide = 2 * inside > self.rows
        parts = [line[a:b] for line, a, b, w in zip(self.order, low, high, wide, strict=True) if not w]
        counts = np.bincount(np.concatenate(parts), minlength=self.rows) if parts else np.zeros(self.rows, np.intp)
        if wide.any():
            parts = [line[:a] for line, a, w in zip(self.order, low, wide, strict=True) if w]
            parts += [line[b:] for line, b, w in zip(self.order, high, wide, strict=True) if w]
            counts = counts + int(wide.sum()) - np.bincount(np.concatenate(parts), minlength=self.rows)
        return counts


class _Search:
    """Keeps the k nearest rows of every query while rows stream past."""

    def __init__(self, block: pa.Table, dims: int, longest: float, k: int) -> None:
        self.dims, self.longest, self.k = dims, longest, k
        self.ids = block["id"].to_numpy()
        self.vectors = matrix(block["vector"], dims)
        self.axes = directions(dims + 1)
        self.centres = self.vectors @ self.axes[:-1]
        self.own = (self.vectors * self.vectors).sum(axis=1)
        self.needed = threshold(dims + 1)
        # Squares of distances carry rounding errors of about this size; windows are so much wider.
        self.error = 1e-6 * longest
        self.kth = np.full(len(self.ids), np.inf)
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in self.ids]

    def scan(self, rows: pa.RecordBatch) -> None:
        ids, vectors = rows.column("id").to_numpy(), matrix(rows.column("vector"), self.dims)
        # The first rows tell about how far the windows have to reach; they are few, as windows start narrow there.
        first = 0 if np.isfinite(self.kth).all() else FIRST
        for at, end in pairwise([0, *range(first or CHUNK, len(ids), CHUNK), len(ids)]):
            self._chunk(ids[at:end], vectors[at:end])

    def _chunk(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors * vectors).sum(axis=1), 0))
        index = SortedArrays(vectors @ self.axes[:-1] + rest[:, None] * self.axes[-1])
        reach = np.sqrt(self.longest**2 + self.own) + self.longest
        # The first window of a query that has found nothing yet holds about k rows of the chunk on a direction.
        start = min(1.0, 2 * self.k / len(ids))
        middle = int(start * (len(ids) - 1))
        narrow = (index.sorted[:, middle:] - index.sorted[:, : len(ids) - middle]).min() / (2 * HALF_WIDTH)
        radius = np.where(np.isfinite(self.kth), self.kth, np.maximum(narrow, 1e-3 * self.longest))
        waiting = np.arange(len(self.ids))
        verified: dict[int, np.ndarray] = {}
        while len(waiting):
            low, high = index.windows(self.centres[waiting], HALF_WIDTH * radius[waiting] + self.error)
            again = []
            for n, query in enumerate(waiting.tolist()):
                near = index.collisions(low[n], high[n]) >= self.needed
                if query in verified:
                    near &= ~verified[query]
                self._verify(query, ids, vectors, np.flatnonzero(near))
                if radius[query] < min(self.kth[query], reach[query]):
                    verified[query] = near | verified[query] if query in verified else near
                    again.append(query)
            waiting = np.array(again, np.intp)
            # No wider than the k-th distance asks for, and at most as wide as any vector can be far.
            wider = np.minimum(radius[waiting] * WIDER, np.minimum(self.kth[waiting], reach[waiting]))
            radius[waiting] = wider

    def _verify(self, query: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        rows = rows[ids[rows] != self.ids[query]]
        if not len(rows):
            return
        # Summed row by row in the same way for every row, so that equal vectors have equal scores.
        scores = (vectors[rows] * self.vectors[query]).sum(axis=1)
        old, known = self.best[query]
        scores, found = np.concatenate([old, scores]), np.concatenate([known, ids[rows]])
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.flatnonzero(scores >= least)
            scores, found = scores[keep], found[keep]
        keep = np.lexsort((found, -scores))[: self.k]
        self.best[query] = scores, found = scores[keep], found[keep]
        if len(scores) == self.k:
            square = self.longest**2 + self.own[query] - 2 * scores[-1]
            self.kth[query] = np.sqrt(max(square, 0.0))

    def result(self) -> pa.RecordBatch:
        sizes = [len(found) for _, found in self.best]
        columns = [np.repeat(self.ids, sizes)]
        columns += [np.concatenate([b[1] for b in self.best]), np.concatenate([b[0] for b in self.best])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def nearest(
    rows: DataFrame, is_query: Callable[[Column], Column], id_col: str, vector_col: str, k: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner products, for every query.

    Queries are the rows for which `is_query`, a condition of the id column, holds; all rows but its own are a query's
    candidates. Ids are whole numbers, scores are doubles from the vectors as given; equal scores are in the order of
    ids. A query with fewer than k candidates gets them all.

    Rows without id or vector, with an empty vector, a zero vector, or a null or non-finite component take no part. Of
    rows that share an id one takes part, the smallest vector, so repeated rows count once. Shorter vectors count as
    filled up with zeros. Without queries or candidates there are no rows. Other columns of `rows` are not looked at.
    """
    vector = F.col(vector_col)
    some = (F.array_max(vector) != 0) | (F.array_min(vector) != 0)
    whole = rows.where(is_whole(vector) & some & F.col(id_col).isNotNull())
    whole = one_per_id(whole.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")), "id")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    whole = stored(whole.withColumn("square", square), "search-vectors")
    n, n_queries, longest, dims = whole.agg(
        F.count("*"), F.count_if(is_query(F.col("id"))), F.max("square"), F.max(F.size("vector"))
    ).first()
    longest = float(np.sqrt(longest or 0.0))
    whole = whole.drop("square")
    found = in_cells(
        whole.where(is_query(F.col("id"))),
        whole,
        (n_queries, n),
        QUERIES,
        lambda block: _Search(block, dims, longest, k),
        "query_id long, vec_id long, score double",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
