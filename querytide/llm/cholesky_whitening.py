"""Whitening components by shifted CholeskyQR.

The centred rows X are never decomposed themselves. A pass over the table adds up the Gram matrix of the rows as they are so
far, its Cholesky factor R is found on the driver (d x d numbers), and the next pass divides the rows by R in a
triangular solve. The first factor is that of the Gram matrix plus a small shift, which exists however close to singular it is;
the passes after it repair what the shift and rounding have left, until the rows are orthonormal. The product of the factors
is the R of X = Q R, and its singular value decomposition gives the components to the precision of a QR
decomposition, where the eigenvectors of the covariance itself would lose half of the digits.

A Gram matrix that stays singular (constant or dependent dimensions) has no Cholesky factor; its symmetric square root takes
the factor's place, which keeps X^T X = R^T R, and the directions without variance drop out as zero singular values.

Every pass sends d x d numbers a task through a shuffle by matrix row; only the sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.errors import InvalidArgumentError
from querytide.llm.common import lists
from querytide.llm.vector_blocks import is_whole, matrix
from querytide.session import no_rows

#: A table's Gram matrix goes to the driver: 32 MB at this many dimensions.
MOST_DIMENSIONS = 2048
#: Rows count as orthonormal when their Gram matrix is as close as this to the identity.
ORTHONORMAL = 1e-12
MOST_PASSES = 6
#: Directions in which rows spread by less than this part of the largest spread hold rounding only, and are no components.
NOTHING = 1e-11
#: Rows that are worked on at once.
ROWS = 4096

Rows = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Centre:
    """Whole-number vectors of the table: their count and their sums by dimension."""

    n: int
    sums: np.ndarray
    scale: int
    offset: int

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self.scale * vectors).astype(np.int64) + self.offset

    def spread(self, whole: np.ndarray) -> np.ndarray:
        """n * x - S: whole numbers, so nothing is lost by centring."""
        return self.n * whole - self.sums

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        return self.spread(self.whole(vectors)) / self.n


def _pieces(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), ROWS):
        yield matrix(column.slice(at, ROWS), dims)


def _summed(rows: DataFrame, dims: int, shape: tuple[int, int], of: Rows, kind: str = "double") -> np.ndarray:
    """The sum of of(vectors), a matrix of the given shape, over all rows."""
    height, width = shape
    arrow = pa.float64() if kind == "double" else pa.int64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for vectors in _pieces(batch.column(0), dims):
                total = of(vectors) if total is None else total + of(vectors)
        if total is not None:
            numbers = lists(total.reshape(-1), np.full(height, width), arrow)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), numbers], names=["line", "numbers"])

    def together(table: pa.Table) -> pa.Table:
        parts = table["numbers"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"line": table["line"].slice(0, 1), "numbers": lists(parts.sum(axis=0), np.array([width]), arrow)})

    schema = f"line int, numbers array<{kind}>"
    found = rows.select("vector").mapInArrow(partial, schema).groupBy("line").applyInArrow(together, schema).collect()
    out = np.zeros(shape, np.float64 if kind == "double" else np.int64)
    for row in found:
        out[row["line"]] = row["numbers"]
    return out


def _gram(rows: DataFrame, dims: int, width: int, of: Rows) -> np.ndarray:
    return _summed(rows, dims, (width, width), lambda vectors: (part := of(vectors)).T @ part)


def factor(gram: np.ndarray, shift: float) -> tuple[np.ndarray, bool]:
    """R with R^T R = gram + shift: upper triangular, or the symmetric root where there is none."""
    shifted = gram + shift * np.eye(len(gram))
    try:
        return np.linalg.cholesky(shifted).T, True
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(gram)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T, False


def divided(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows * R1^-1 * R2^-1 ..., each by a triangular solve."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def triangular_factor(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int, dims: int) -> np.ndarray:
    """The R of the centred rows, from their Gram matrices after division by the factors found so far."""
    gram = gram_of([])
    unit = np.finfo(np.float64).eps / 2
    # The shift that CholeskyQR needs to succeed at any condition number.
    shift = 11 * (n * dims + dims * (dims + 1)) * unit * float(np.trace(gram))
    shift = min(shift, 1e-3 * float(np.trace(gram)) / max(dims, 1))
    r, factors = np.eye(dims), []
    for _ in range(MOST_PASSES):
        found, triangular = factor(gram, shift)
        r = found @ r
        if not triangular or not np.isfinite(found).all():
            break
        if np.abs(gram - np.eye(dims)).max() < ORTHONORMAL:
            break
        factors.append(found)
        gram, shift = gram_of(factors), 0.0
    return r


@dataclass(frozen=True)
class Whitening:
    """What has been fitted: components (rows) by falling eigenvalue of the covariance, and their part of its trace."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whitened(self, vectors: np.ndarray) -> np.ndarray:
        return self.centre.centred(vectors) @ self.components.T / np.sqrt(self.eigenvalues)


def _vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.where(is_whole(F.col(vector_col))).select(F.col(vector_col).alias("vector"))


def fit(rows: DataFrame, vector_col: str, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Fit on every row with a whole vector; None without such rows."""
    vectors = _vectors(rows, vector_col)
    n, dims, low, high = vectors.agg(
        F.count("*"),
        F.max(F.size("vector")),
        F.min(F.array_min("vector").cast("double")),
        F.max(F.array_max("vector").cast("double")),
    ).first()
    if not n:
        return None
    largest = max(abs(scale * low), abs(scale * high)) + abs(offset) + 1
    if dims > MOST_DIMENSIONS or largest * n >= 2**62:
        raise InvalidArgumentError(f"{n} vectors of {dims} components from {low} to {high} are beyond exact sums")
    bare = Centre(n, np.zeros(dims, np.int64), scale, offset)
    sums = _summed(vectors, dims, (1, dims), lambda v: bare.whole(v).sum(axis=0), "long")[0]
    centre = Centre(n, sums, scale, offset)
    r = triangular_factor(
        lambda factors: _gram(vectors, dims, dims, lambda v: divided(centre.centred(v), factors)), n, dims
    )
    _, sizes, turned = np.linalg.svd(r)
    rank = int((sizes > sizes[0] * NOTHING).sum()) if sizes[0] > 0 else 0
    kept = min(components, rank)
    eigenvalues = sizes**2 / n
    return Whitening(centre, turned[:kept], eigenvalues[:kept], eigenvalues[:kept] / (eigenvalues.sum() or 1.0))


def identity_error(rows: DataFrame, vector_col: str, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on every row."""
    kept, dims = len(fitted.components), len(fitted.centre.sums)

    def with_ones(vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([fitted.whitened(vectors), np.ones(len(vectors))])

    sums = _gram(_vectors(rows, vector_col), dims, kept + 1, with_ones) / fitted.centre.n
    covariance = sums[:kept, :kept] - np.outer(sums[kept, :kept], sums[kept, :kept])
    return float(np.abs(covariance - np.eye(kept)).max(initial=0.0))


def whiten(
    rows: DataFrame, id_col: str, vector_col: str, components: int = 32, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    A component x of a vector counts as floor(scale * x) + offset. Components of the covariance (divisor n) are numbered
    from 1 by falling eigenvalue; `whitened` is the centred row projected on one, over the root of its eigenvalue;
    `explained` is its eigenvalue's part of the trace. `deviation` is the sum over dimensions of (n * x - S)^2, S being the
    sums of the n rows; it is exact, and null where it is beyond a long.

    Rows without a vector, with an empty vector or with a null or non-finite component are dropped; a null id is kept as
    it is, and rows that share an id, or are repeated, each count and are each returned. Shorter vectors count as filled
    up with zeros. There are no more components than the covariance has rank, so a table of equal vectors, of one row or
    of none gives no rows. Equal eigenvalues may be turned among each other. Vectors of more than 2,048 dimensions and
    sums beyond 2^62 raise InvalidArgumentError. Other columns of `rows` are not looked at.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, vector_col, components, scale, offset)
    if fitted is None or not len(fitted.components):
        return no_rows(rows.sparkSession, T.StructType.fromDDL(schema)).withColumnRenamed("id", id_col)
    error = identity_error(rows, vector_col, fitted)
    centre, kept, dims = fitted.centre, len(fitted.components), len(fitted.centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors, n = matrix(part.column(1), dims), part.num_rows
                spread = centre.spread(centre.whole(vectors))
                beyond = (spread.astype(np.float64) ** 2).sum(axis=1) >= 2.0**63 * (1 - 1e-12)
                deviation = pa.array((spread * spread).sum(axis=1), pa.int64(), mask=beyond)
                row = pa.array(np.repeat(np.arange(n), kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * kept, centre.n)),
                        deviation.take(row),
                        pa.array(fitted.whitened(vectors).reshape(-1)),
                        pa.array(np.tile(fitted.explained, n)),
                        pa.array(np.full(n * kept, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    whole = rows.where(is_whole(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return whole.mapInArrow(run, schema).withColumnRenamed("id", id_col)
