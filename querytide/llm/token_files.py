"""Token ids in Parquet files: list columns, dictionary and delta encoding, bounded row groups, page indexes.

Files hold documents in ascending doc_id order; the parts follow each other in the same order. Columns: part (number of
the file), doc_id, place (ids before the document in its file), n_tokens, tokens. Token lists are dictionary-encoded;
the other columns, which rise slowly, use delta encoding. Row groups and pages are small enough that a filter on
doc_id, or a read of the narrow columns alone, touches little of a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querytide.llm.common import lists
from querytide.llm.pieces import PieceEncoder, kept, read_vocabulary

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> None:
    """Encode every whole text, append `end_id` to each, and write the files.

    A null text is empty and gets the end id alone. Documents without an id come first; documents that share an id
    are ordered by their text. An empty table gives files without rows. Columns of `docs` other than the two are not
    written.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast({"source": read_vocabulary(vocabulary)})
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        encoder = kept(source.value, PieceEncoder)
        for batch in batches:
            first = 0
            for ids, counts in encoder.encode_all(batch.column(1)):
                counts = counts + 1
                ends = np.cumsum(counts)
                tokens = np.full(ends[-1], end_id, np.uint32)
                tokens[np.delete(np.arange(ends[-1]), ends - 1)] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, np.int32)),
                        batch.column(0).slice(first, len(counts)),
                        pa.array(place + ends - counts),
                        pa.array(counts),
                        lists(tokens.view(np.int32), counts, pa.int32()),
                    ],
                    names=["part", "doc_id", "place", "n_tokens", "tokens"],
                )
                first, place = first + len(counts), place + int(ends[-1])

    schema = "part int, doc_id long, place long, n_tokens long, tokens array<int>"
    writer = ordered.mapInArrow(run, schema).write.option("compression", "zstd")
    writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    writer = writer.option("parquet.enable.dictionary#tokens.list.element", "true")
    writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    writer.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def read_token_files(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """part, doc_id, start (ids of all documents before it), n_tokens and, unless left out, tokens.

    The starts come from the narrow columns of the files: one sum per file, added up over the files in order. Those
    sums are one row per file, which bounds what is broadcast."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    found = files.join(F.broadcast(bases), "part")
    kept = ["part", "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens"]
    return found.select(*kept, *["tokens"] * tokens)


def with_crc32(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = np.asarray(ids.flatten()).astype("<u4")
            ends = np.cumsum(np.asarray(ids.value_lengths()))
            sums = [zlib.crc32(x) for x in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    chosen = read.select("doc_id", "start", "n_tokens", "tokens")
    return chosen.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
