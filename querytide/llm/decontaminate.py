"""Removing benchmark passages from training texts by a broadcast set of normalised word n-grams.

The benchmark's n-grams become a set of word-number sequences that every task holds; a document is scanned window by
window. Only stretches of words that all occur in the benchmark are looked up, and a look-up compares the words'
numbers themselves, so each hit is verified. The set is built from blocks of items whose text is at most `BLOCK_BYTES`
each, so what is broadcast at once is bounded; a larger benchmark passes over the documents block after block within
the same stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import as_bytes, fresh, lists

#: Words of a window, and text bytes of the items in one broadcast block.
WINDOW = 10
BLOCK_BYTES = 16 << 20
#: A document goes if this share of its words or more is hit.
DROP_SHARE = 0.5
#: Fixed value: a word is a run of digits, ASCII letters (made lower case) and characters beyond ASCII.
_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The n-grams of some items."""

    def __init__(self, items: list[tuple[int, bytes]], n: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set[int]]] = {}
        for item, text in items:
            row = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised_words(text)]
            row, size = np.array(row, np.uint32), min(n, len(row))
            if size:
                of = self.items.setdefault(size, {})
                for i in range(len(row) - size + 1):
                    of.setdefault(row[i : i + size].tobytes(), set()).add(item)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items found."""
        get = self.numbers.get
        row = np.array([get(w, 0) for w in words], np.uint32)
        marks, found = np.zeros(len(row), bool), set()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row != 0, [0]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        for size, of in self.items.items():
            for k in np.flatnonzero(ends - starts >= size):
                first, last = int(starts[k]), int(ends[k]) - size
                data = row[first : last + size].tobytes()
                for i in range(last - first + 1):
                    if (items := of.get(data[4 * i : 4 * (i + size)])) is not None:
                        found |= items
                        marks[first + i : first + i + size] = True
        return marks, found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about `limit` bytes of text; the driver holds one partition and one block at a time."""
    block, size, first = [], 0, True
    for item, text in benchmark.select("item_id", F.encode("text", "utf-8")).toLocalIterator():
        text = bytes(text or b"")
        if block and size + len(text) > limit:
            yield block
            block, size, first = [], 0, False
        block.append((item, text))
        size += len(text)
    if block or first:
        yield block


def _scanned(docs: DataFrame, text_col: str, benchmark: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """`docs` with three columns more at the end: number of words, spans, items."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    names = [fresh(docs.columns, x) for x in ("n_words", "spans", "items")]
    found = docs.select(
        *docs.columns,
        F.lit(0).cast("long").alias(names[0]),
        F.array().cast("array<long>").alias(names[1]),
        F.array().cast("array<string>").alias(names[2]),
    )
    for block in _blocks(benchmark, block_bytes):
        found = found.mapInArrow(_scan(context.broadcast(block), at, n), found.schema)
    return found


def _scan(block, at: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value, n)
        for batch in batches:
            counts, spans, items = [], [], []
            for text, old, listed in zip(as_bytes(batch.column(at)), batch.column(-2), batch.column(-1), strict=True):
                words = normalised_words(text)
                marks, ids = windows.hits(words)
                old, listed = old.as_py(), listed.as_py()
                for first, last in zip(old[::2], old[1::2], strict=True):
                    marks[first:last] = True
                counts.append(len(words))
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], marks, [0]]).astype(np.int8))))
                items.append(sorted({*listed, *(str(i) for i in ids if i is not None)}))
            flat = np.concatenate([np.zeros(0, np.int64), *spans])
            new = [
                pa.array(counts, pa.int64()),
                lists(flat.astype(np.int64), np.array([len(s) for s in spans], np.int64), pa.int64()),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=batch.schema.names)

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scan every whole text for the benchmark's windows of `n` words; a shorter item is one window of its own length.

    Returns doc_id, n_words, spans (first word and word after the last, in turn, ascending) and items (the item_ids with
    a window in the document, as strings in their order), one row per row of `docs`. Texts and items that are null or
    without words have no windows, nor has an empty benchmark. Items without an id mark words but are not listed; items
    that share an id count as one. Other columns of `docs` are left out, so their names cannot clash.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _scanned(docs, "text", benchmark, n, block_bytes).drop("text")


def leak_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of find_leaks()'s rows."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = DROP_SHARE,
    n: int = WINDOW,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` without documents of whose words `share` or more are hit, and with the hit spans cut out of the others.

    A cut goes from the first character of a span's first word to the last of its last word. Documents without a hit
    stay as they are, nulls included. Returns the columns of `docs`, in order."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for i, (words, spans) in enumerate(zip(batch.column(-3), batch.column(-2), strict=True)):
                spans = spans.as_py()
                hit = sum(spans[1::2]) - sum(spans[::2])
                keep.append(not hit or hit < share * words.as_py())
                if hit and keep[-1]:
                    texts[i] = _cut(texts[i].encode(), spans).decode()
            columns = list(batch.columns[:-3])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-3]).filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, text_col, benchmark, n, block_bytes).mapInArrow(run, docs.schema)


def _cut(text: bytes, spans: list[int]) -> bytes:
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, last in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[first][0]])
        at = places[last - 1][1]
    return b"".join([*out, text[at:]])
