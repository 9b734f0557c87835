"""Helpers shared by the operators: whole-table reads, byte words, word hashes and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the characters between words, as the contracts state them. bytes.split() uses the same six.
GAP = r"[ \t-\r]+"
#: Words kept in a worker's table before it starts over; bounds the worker's memory, not the results.
CACHE_WORDS = 600_000
_BASE = 0x9E3779B97F4A7C15
_NOTHING = object()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as UTF-8; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def give_back() -> None:
    """Hand freed memory back to the system. Objects that refer to each other, Arrow and the C library would hold it in an
    idle worker, beside the heap of the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Cache(dict):
    """A dictionary that computes missing values. When half of `size` is new, what has not been asked for since the last
    time that happened is forgotten, so frequent keys stay."""

    def __init__(self, make: Callable, size: int = CACHE_WORDS) -> None:
        super().__init__()
        self.make, self.half, self.older = make, max(1, size // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, _NOTHING)
        value = self[key] = self.make(key) if value is _NOTHING else value
        return value


class Powers:
    """Rolling sums of word hashes: the hash of words[i:j] for any i and j, in the ring of 64-bit integers."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up = _powers(self.base, size)
                self.down = _powers(self.inverse, size)

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self._reach(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The hash of every run of n words."""
        count = len(prefix) - n
        return mixed((prefix[n:] - prefix[:count]) * self.down[:count])


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done, step = 1, base
    while done < size:
        take = min(done, size - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step % (1 << 64)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of byte words."""

    def __init__(self) -> None:
        self.cache = Cache(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
