"""Where in a text one of many words may begin: a rolling hash of the characters from each position, tested by a filter of bits.

Plain numpy over one text at a time; Spark cuts the tables and calls these in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Bits of the filter of a class's beginnings: 32 KB, which go with the plan.
BITS = 1 << 18
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
# Rows of a batch that is handed on.
_ROWS = 50_000


def hashes(text: str, size: int) -> np.ndarray:
    """A number for the `size` characters from each position; none if the text is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = max(0, len(points) - size + 1)
    found = np.zeros(count, np.uint64)
    for k in range(size):
        found = found * np.uint64(_BASE) + points[k : k + count]
    found = (found ^ (found >> np.uint64(32))) * np.uint64(_MIX)
    return found ^ (found >> np.uint64(32))


def bits(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BITS - 1)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column.cast(pa.large_binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


def beginning_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_class, bit) of each (_class, _beginning)."""
    for batch in batches:
        sizes = batch.column(0).to_pylist()
        found = [int(bits(hashes(text, size))[0]) for size, text in zip(sizes, _texts(batch.column(1)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["_class", "bit"])


def places(size: int, whole: bool, numbers: list[int], names: list[str]) -> Callable:
    """(hash, at, beginning) of each position, counted from 1, of each (hash, text) at which a word may begin.

    `whole` says that the words are no longer than their beginnings; then one position of each beginning is enough."""
    filled = np.unpackbits(np.array(numbers, np.int64).view(np.uint8), bitorder="little").astype(bool)

    def made(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, str]] = []
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = hashes(text, size)
                at = np.flatnonzero(filled[bits(found)])
                if whole:
                    at = at[np.unique(found[at], return_index=True)[1]]
                for part in range(0, len(at), _ROWS):
                    rows += [(key, k + 1, text[k : k + size]) for k in at[part : part + _ROWS].tolist()]
                    if len(rows) >= _ROWS:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return run


# Executors get these functions with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
