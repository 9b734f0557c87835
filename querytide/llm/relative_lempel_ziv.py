"""Repeated passages by hashes of content-cut blocks and of windows.

Every document is cut by its content into blocks: the windows of WINDOW words that share their smallest ANCHOR-word hash
form a run, and the words of a run are a block. Equal passages are cut alike, so the distinct blocks, each with the
first document that has it, are an index of the whole corpus in about a fourteenth of its windows. A block of a document
that an earlier document has is covered in full. These hashes, and not a parse, decide which words are repeated; the
factors are joined from them afterwards, block by block with the first source of each, so a longer factor from a later
source is not found.

A match may end inside a block. A window lies in a block that has the window's own anchor, so
only blocks whose anchor occurs in several distinct blocks can share windows without being equal. Those few blocks, one
copy of each, are checked window by window by their hashes. So every window that starts in an earlier document is found,
whether that document is the first with the block or not.

Windows and blocks are compared by two 64-bit hashes; hot passages are combined before each shuffle, by (block) and by
(window), and never meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import Powers, WordHashes, as_bytes, lists, signed
from querytide.session import stored

#: Words of a window, and of the pieces whose smallest hash anchors it.
WINDOW, ANCHOR = 50, 25
#: Second base of the rolling hashes, and the bytes of text per batch handed back.
_SECOND, _BATCH_BYTES = 0xC2B2AE3D27D4EB4F, 4 << 20


class Cutter:
    """Hashes of a document's windows and blocks."""

    def __init__(self) -> None:
        self.hashes, self.one, self.two = WordHashes(), Powers(), Powers(_SECOND)

    def read(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words and the two prefix sums."""
        words = self.hashes(text.split())
        return len(words), self.one.prefix(words), self.two.prefix(words)

    def blocks(self, text: bytes) -> tuple[np.ndarray, ...]:
        """First window, number of windows, anchor and two hashes of each block."""
        n, one, two = self.read(text)
        if n < WINDOW:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
        least, span = self.one.grams(one, ANCHOR), 1
        goal = WINDOW - ANCHOR + 1
        while span < goal:
            step = min(span, goal - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.concatenate([first, [len(least)]]))
        stop = first + count + WINDOW - 1
        return first, count, least[first], self.one.spans(one, first, stop), self.two.spans(two, first, stop)


def _tag(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text) << 32


def _blocks(docs: DataFrame) -> DataFrame:
    """doc_id, place (hash of the text and first window, 32 bits each), count, anchor, r1, r2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            size, parts = 0, []
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)):
                first, count, anchor, r1, r2 = cutter.blocks(text)
                place = first.astype(np.uint64) | np.uint64(_tag(text))
                parts.append((np.full(len(first), name, np.int64), signed(place), count, anchor, r1, r2))
                size += len(text)
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [signed(np.concatenate(c)) for c in zip(*parts, strict=True)]
                    columns[2] = columns[2].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=["doc_id", "place", "count", "anchor", "r1", "r2"]
                    )
                    size, parts = 0, []

    return docs.mapInArrow(run, "doc_id long, place long, count int, anchor long, r1 long, r2 long")


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, place, w1, w2 of each window of the blocks listed in `places` and `counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for name, text, places, counts in zip(*(as_bytes(c) if k == 1 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                tag = np.uint64(_tag(text))
                listed, counts = np.array(places, np.int64).view(np.uint64), np.array(counts, np.int64)
                own = (listed >> np.uint64(32)) << np.uint64(32) == tag
                if not own.any():
                    continue
                _, one, two = cutter.read(text)
                first = (listed[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                at = np.unique(np.concatenate([np.arange(f, f + c) for f, c in zip(first, counts[own], strict=True)]))
                hashes = [p.spans(x, at, at + WINDOW) for p, x in ((cutter.one, one), (cutter.two, two))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), name, np.int64)),
                        pa.array(signed(at.astype(np.uint64) | tag)),
                        *(pa.array(signed(h)) for h in hashes),
                    ],
                    names=["doc_id", "place", "w1", "w2"],
                )

    return docs.select("doc_id", "text", "places", "counts").mapInArrow(run, "doc_id long, place long, w1 long, w2 long")


def _earlier(docs: DataFrame) -> DataFrame:
    """doc_id, place, count, source: runs of windows that also start in the earlier document `source`."""
    blocks = _blocks(docs)
    anchors = blocks.groupBy("anchor").count().filter("count > 1").select("anchor")
    met = stored(blocks.join(stored(anchors, "anchors"), "anchor"), "blocks")
    index = met.groupBy("r1", "r2").agg(F.min("doc_id").alias("source"), F.first("anchor").alias("anchor"))
    index = stored(index, "block-index")
    varied = index.groupBy("anchor").count().filter("count > 1").select("anchor")
    placed = met.join(index.drop("anchor"), ["r1", "r2"]).drop("r1", "r2")
    whole = placed.filter("doc_id > source").select("doc_id", "place", "count", "source")

    first = placed.filter("doc_id = source").join(stored(varied, "varied"), "anchor")
    first = first.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list("count").alias("counts"))
    windows = stored(_windows(docs.join(stored(first, "first-blocks"), "doc_id")), "windows")
    seen = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    seen = stored(seen.filter("source < last").drop("last"), "window-index")
    parts = windows.join(seen, ["w1", "w2"]).filter("doc_id > source")
    return whole.union(parts.select("doc_id", "place", F.lit(1).alias("count"), "source"))


def factor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factor every whole text against the documents with smaller ids.

    Returns doc_id, n_words, factors (array of start, words, source: stretches of WINDOW words or
    more, each in one earlier document, not always the longest there are), spans (first word and word after the last of the covered stretches, in turn)
    and kept (the words outside, joined by one blank), one row per row of `docs`. Null texts have no words. Rows that
    share an id are not earlier than each other; a row without an id is neither earlier than another nor covered. Other
    columns are left out, so their names cannot clash. An empty table gives none."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = chosen.filter("doc_id IS NOT NULL")
    runs = _earlier(named)
    covered = runs.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("place", "count", "source")])
    none = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("place", "long"), ("count", "int"), ("source", "long"))]
    rows = named.join(stored(covered, "covered"), "doc_id", "left")
    return _factored(rows.union(chosen.filter("doc_id IS NULL").select("doc_id", "text", *none)))


def _factored(rows: DataFrame) -> DataFrame:
    schema = "doc_id long, n_words long, factors array<struct<start: long, words: long, source: long>>, spans array<long>, kept string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(0).to_pylist(), as_bytes(batch.column(1)), *(c.to_pylist() for c in batch.columns[2:])]
            for i, (name, text, places, counts, sources) in enumerate(zip(*columns, strict=True)):
                words = text.split()
                tag = _tag(text)
                runs = sorted(
                    (p & 0xFFFFFFFF, c, s)
                    for p, c, s in zip(places or (), counts or (), sources or (), strict=True)
                    if (p & (2**64 - 1)) >> 32 << 32 == tag
                )
                spans = _spans(runs)
                edges = [0, *spans, len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                out.append((name, len(words), _greedy(runs), spans, b" ".join(kept).decode()))
                size += len(text)
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    names, counted, factors, covers, texts = zip(*out, strict=True)
                    flat = np.array([x for c in covers for x in c], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names, pa.int64()),
                            pa.array(counted, pa.int64()),
                            pa.array(factors, kind),
                            lists(flat, np.array([len(c) for c in covers]), pa.int64()),
                            pa.array(texts, pa.string()),
                        ],
                        names=["doc_id", "n_words", "factors", "spans", "kept"],
                    )
                    out, size = [], 0

    return rows.mapInArrow(run, schema)


def _spans(runs: list[tuple[int, int, int]]) -> list[int]:
    """Stretches of words covered by the runs' windows: first word and word after the last, in turn."""
    spans: list[int] = []
    for first, count, _ in runs:
        stop = first + count - 1 + WINDOW
        if spans and first <= spans[-1]:
            spans[-1] = max(spans[-1], stop)
        else:
            spans += [first, stop]
    return spans


def _greedy(runs: list[tuple[int, int, int]]) -> list[dict]:
    """The runs parsed from left to right: at each place the longest factor that one source gives, and the next factor
    where it ends."""
    chains: list[list[int]] = []
    last: dict[int, list[int]] = {}
    for first, count, source in runs:
        chain = last.get(source)
        if chain and first <= chain[0] + chain[1]:
            chain[1] = max(chain[1], first + count - chain[0])
        else:
            chain = last[source] = [first, count, source]
            chains.append(chain)
    factors, at = [], 0
    for first, count, source in sorted(chains, key=lambda c: (c[0], -c[1])):
        start, stop = max(first, at), first + count
        if start < stop:
            factors.append({"start": start, "words": stop - start + WINDOW - 1, "source": source})
            at = stop
    return factors


def kept_digests(factored: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of factor()'s rows."""
    turn = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    removed = F.aggregate(turn, F.lit(0).cast("long"), lambda total, x: total + x)
    return factored.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
