"""Hard negatives by Four-Russians scoring: exact integer scores from tables of subset sums.

Vectors of whole numbers are cut into groups of eight dimensions. For a block of anchors, a table holds the sum of every
subset of a group's eight components: 256 entries a group. A candidate is stored as the bit planes of its components in
two's complement, one byte for a plane and a group, so a byte names a subset. A score is the sum over planes, from the
sign plane down, of the looked-up sums, doubled from plane to plane: lookups, additions and shifts, no product.

Scores are needed twice: those of an anchor's own label find its positives, those of the other labels its negatives. Every
pair of an anchor and a row is scored once. Pairs are worked off in cells of `vector_blocks`, and a cell returns
no more rows of an anchor than can be in the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.errors import InvalidArgumentError
from querytide.llm.vector_blocks import first_of_each, in_cells, is_whole, matrix, one_per_id
from querytide.session import stored

GROUP = 8
#: Whole numbers up to this size take part, so that sums over 4,096 dimensions fit into 64 bits.
MOST = 1 << 25
MOST_DIMENSIONS = 4096
#: Bytes of a cell's tables, and its anchors at most.
TABLE_BYTES = 32 << 20
ANCHORS = 1024
#: Anchors and rows that are scored at once, so that a group's table and the scores stay in the cache.
COLUMNS = 256
ROWS = 1024

_ROW = "id long, label long, planes binary"


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, planes, groups) bytes of the two's complement of `values`, lowest plane first."""
    n, dims = values.shape
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = values
    out = np.empty((n, bits, padded.shape[1] // GROUP), np.uint8)
    for b in range(bits):
        plane = ((padded >> b) & 1).astype(np.uint8).reshape(n, -1, GROUP)
        out[:, b] = np.packbits(plane, axis=-1, bitorder="little")[..., 0]
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of bit planes."""
    n, bits, groups = planes.shape
    ones = np.unpackbits(planes, axis=-1, bitorder="little").astype(np.int64)
    weights = np.array([1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))], np.int64)
    return np.einsum("nbd,b->nd", ones, weights).reshape(n, groups * GROUP)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for every group, the sums of the subsets of its components."""
    n, dims = anchors.shape
    parts = anchors.T.reshape(dims // GROUP, GROUP, n).astype(kind)
    sums = np.zeros((dims // GROUP, 1 << GROUP, n), kind)
    for bit in range(GROUP):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + parts[:, bit, None]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the inner products, by lookups and shifts."""
    n, bits, _ = planes.shape
    subsets = np.ascontiguousarray(planes.transpose(1, 2, 0)).astype(np.intp)
    total = np.zeros((n, sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        np.left_shift(total, 1, out=total)
        for group, table in enumerate(sums):
            np.take(table, subsets[b, group], axis=0, out=found, mode="clip")
            (np.subtract if b == bits - 1 else np.add)(total, found, out=total)
    return total


class _Block:
    """Keeps the first k rows for every anchor and window of scores while rows stream past."""

    def __init__(self, block: pa.Table, bits: int, k: int, same: bool) -> None:
        self.bits, self.k, self.same = bits, k, same
        # Anchors are worked off label by label, so that a label's rows meet neighbouring columns only.
        block = block.sort_by([("label", "ascending"), ("id", "ascending")])
        self.ids = block["id"].to_numpy()
        self.labels = block["label"].to_numpy()
        self.values = values_of(_planes(block["planes"].combine_chunks(), bits))
        largest = int(np.abs(self.values).sum(axis=1).max()) << bits
        kind = np.int32 if largest < 1 << 30 else np.int64
        self.sums = [
            subset_sums(self.values[at : at + COLUMNS], kind) for at in range(0, len(self.ids), COLUMNS)
        ]
        if same:
            self.low = np.full((len(self.ids), 1), -(1 << 62))
            self.high = np.full((len(self.ids), 1), 1 << 62)
        else:
            self._windows(block["positives"].combine_chunks())
        # The score of the k-th row so far; lower ones can't be in the result.
        self.least = self.low.copy()
        nothing = np.empty(0, np.int64)
        self.best = [(nothing, nothing, nothing) for _ in self.sums]

    def _windows(self, positives: pa.ListArray) -> None:
        """Negatives must have 30 to 90 hundredths of the positive's score."""
        counts = positives.value_lengths().to_numpy(zero_copy_only=False)
        width = max(1, int(counts.max()))
        own = np.zeros((len(counts), width), np.int64)
        there = np.arange(width) < counts[:, None]
        own[there] = positives.flatten().field("score").to_numpy()
        self.low = np.where(there, -(-30 * own // 100), 1)
        self.high = np.where(there, 90 * own // 100, 0)

    def scan(self, rows: pa.RecordBatch) -> None:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        planes = _planes(rows.column("planes"), self.bits)
        if self.same:
            order = np.argsort(labels, kind="stable")
            ids, labels, planes = ids[order], labels[order], planes[order]
            self._same_label(ids, labels, planes)
        else:
            for at in range(0, len(ids), ROWS):
                step = slice(at, at + ROWS)
                for k, sums in enumerate(self.sums):
                    first = k * COLUMNS
                    own = self.labels[first : first + sums.shape[2]]
                    self._take(first, scores(sums, planes[step]), ids[step], labels[step][:, None] != own)

    def _same_label(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        for label in np.intersect1d(self.labels, labels):
            low, high = np.searchsorted(labels, [label, label + 1])
            first, last = np.searchsorted(self.labels, [label, label + 1])
            while first < last:
                at = first % COLUMNS
                end = min(COLUMNS, at + last - first)
                # Contiguous, as the lookups copy whole rows.
                sums = np.ascontiguousarray(self.sums[first // COLUMNS][:, :, at:end])
                for start in range(low, high, ROWS):
                    step = slice(start, min(start + ROWS, high))
                    other = ids[step][:, None] != self.ids[first : first + end - at]
                    self._take(first, scores(sums, planes[step]), ids[step], other)
                first += end - at

    def _take(self, first: int, found: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Add the scores of the anchors from `first` on that may be among the first k of a window."""
        columns = slice(first, first + found.shape[1])
        least, high = self.least[columns], self.high[columns]
        near = allowed & (found >= least.min(axis=1)) & (found <= high.max(axis=1))
        row, column = np.nonzero(near)
        if not len(row):
            return
        got = found[row, column].astype(np.int64)
        inside = (got[:, None] >= least[column]) & (got[:, None] <= high[column])
        hit, window = np.nonzero(inside)
        if not len(hit):
            return
        width = self.low.shape[1]
        keys = (first + column[hit]) * width + window
        new, best = (keys, got[hit], ids[row[hit]]), self.best[first // COLUMNS]
        keys, got, ids = (np.concatenate(both) for both in zip(best, new, strict=True))
        keep = first_of_each(keys, got, ids, self.k)
        keys, got, ids = self.best[first // COLUMNS] = keys[keep], got[keep], ids[keep]
        last = np.arange(self.k - 1, len(keys))
        last = last[keys[last] == keys[last - self.k + 1]]
        self.least.reshape(-1)[keys[last]] = got[last]

    def result(self) -> pa.RecordBatch:
        keys, got, ids = (np.concatenate(parts) for parts in zip(*self.best, strict=True))
        width = self.low.shape[1]
        columns = [self.ids[keys // width], (keys % width).astype(np.int32), ids, got]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "window", "found_id", "score"])


def _planes(column: pa.Array, bits: int) -> np.ndarray:
    n = len(column)
    groups = len(column[0].as_py()) // bits
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + 2]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[0] + n * bits * groups].reshape(n, bits, groups)


def _packed(rows: DataFrame, scale: int, dims: int, bits: int) -> DataFrame:
    """(id, label, planes): every row's whole numbers as bit planes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.floor(scale * matrix(batch.column(2), dims)).astype(np.int64)
                flat = planes_of(values, bits).reshape(batch.num_rows, -1)
                offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
                planes = pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), planes], names=["id", "label", "planes"])

    return rows.mapInArrow(run, _ROW)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of every key over all cells, numbered."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    id_col: str,
    vector_col: str,
    label_col: str,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x count as floor(scale * x), scores are inner products. An anchor's positives are its best `positives`
    other rows of its label; for each, its negatives are the best `negatives` rows of other labels whose scores lie
    between 30 and 90 hundredths of the positive's. Equal scores are in the order of ids. Ids and labels are whole
    numbers; `is_anchor` makes a condition of the id column.

    Rows without id, label or vector, with an empty vector or with a null or non-finite component take no part. Of rows
    that share an id one takes part, the smallest in label and vector, so repeated rows count once. Vectors of
    different lengths are compared over the components both have. Anchors without positives, and positives without
    negatives, give no row; nor does an empty table. Components beyond 2^25 after scaling, or more than 4,096 of them,
    raise InvalidArgumentError. Other columns of `rows` are not looked at.
    """
    vector = F.col(vector_col)
    known = is_whole(vector) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    whole = rows.where(known).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")
    )
    n, n_anchors, low, high, dims = whole.agg(
        F.count("*"),
        F.count_if(is_anchor(F.col("id"))),
        F.min(F.array_min("vector").cast("double")),
        F.max(F.array_max("vector").cast("double")),
        F.max(F.size("vector")),
    ).first()
    low, high, dims = (low, high, dims) if n else (0.0, 0.0, 1)
    if max(-low, high) * scale > MOST or dims > MOST_DIMENSIONS:
        raise InvalidArgumentError(f"{dims} components from {low} to {high} are beyond the range of exact scores")
    bits = max(int(np.floor(scale * high)), -int(np.floor(scale * low)) - 1, 0).bit_length() + 1
    packed = stored(_packed(one_per_id(whole, "id"), scale, dims, bits), "hard-negative-planes")

    nothing = F.lit(None).cast("array<struct<id:long,score:long>>")
    candidates = packed.withColumn("positives", nothing)
    anchors = candidates.where(is_anchor(F.col("id")))
    block = min(ANCHORS, max(1, TABLE_BYTES // (-(-dims // GROUP) * 8 << GROUP)))
    found = "anchor_id long, window int, found_id long, score long"
    best = in_cells(anchors, candidates, (n_anchors, n), block, lambda b: _Block(b, bits, positives, True), found)
    best = _first(best, ["anchor_id"], positives)
    listed = best.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives")
    )
    listed = stored(listed, "hard-negative-positives")

    pairs = F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))
    asked = packed.join(listed.select(F.col("anchor_id").alias("id"), pairs.alias("positives")), "id")
    worst = in_cells(asked, candidates, (n_anchors, n), block, lambda b: _Block(b, bits, negatives, False), found)
    worst = _first(worst, ["anchor_id", "window"], negatives)
    own = F.get("positives", "window")
    return worst.join(listed, "anchor_id").select(
        "anchor_id",
        own["id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"),
        own["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
