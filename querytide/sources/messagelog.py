"""A folder of archived messages as a stream with offsets: bounded fetches, committed positions, exact resumption.

The folder has one subfolder `partition=<n>` for each partition, with Parquet files whose rows rise by offset and whose
footers tell their first and last offset. A micro-batch takes from every partition the next messages up to a share of the
fetch size. Where a batch ends is decided here and recorded by the query's checkpoint; `commit` also writes it to a file of
the consumer group, from which a reader that has no checkpoint, or a new process, goes on.

Spark asks a Python source only for its newest position, so every answer is one fetch further. A trigger that runs once
would thus take one fetch; run the stream on a processing-time trigger.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "message_log"
# Fixed value: largest fetch, in bytes.
FETCH_BYTES = 10_000_000
_SCHEMA = "key binary, value binary, partition int, offset bigint, timestamp timestamp"


@dataclass(frozen=True)
class Piece:
    """A row group, the offsets in it, and its bytes."""

    file: str
    group: int
    first: int
    last: int
    size: int

    def upto(self, first: int, room: float) -> int:
        """The offset after as many messages from `first` on as take up `room` bytes, at least one."""
        each = max(1.0, self.size / (self.last - self.first + 1))
        return min(self.last + 1, max(first, self.first) + max(1, int(room / each)))


class Slice(InputPartition):
    def __init__(self, partition: int, file: str, group: int, first: int, end: int) -> None:
        self.partition, self.file, self.group, self.first, self.end = partition, file, group, first, end


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.group = options.get("group")
        self.fetch = int(options.get("fetchbytes", FETCH_BYTES))
        self.pieces: dict[int, dict[str, list[Piece]]] = {}
        self.reached: dict[str, int] | None = None

    # Positions: {partition: offset of the next message}.

    def _group_file(self) -> str:
        return f"{self.path}/_groups/{self.group}.json"

    def _committed(self) -> dict[str, int]:
        if not self.group:
            return {}
        files, path = _opened(self._group_file())
        if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return {}
        with files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def initialOffset(self) -> dict:
        return self._committed()

    def latestOffset(self) -> dict:
        start = self._committed() if self.reached is None else self.reached
        self._look()
        room = self.fetch / max(1, len(self.pieces))
        self.reached = {**start, **{str(p): self._next(p, start.get(str(p), 0), room) for p in self.pieces}}
        return self.reached

    def _look(self) -> None:
        """Learn the row groups of files that are new since the last look."""
        files, path = _opened(self.path)
        found = files.get_file_info(pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True))
        for info in found:
            folder, name = os.path.split(info.path)
            folder = os.path.basename(folder)
            if not folder.startswith("partition=") or name.startswith((".", "_")) or not name.endswith(".parquet"):
                continue
            known = self.pieces.setdefault(int(folder.partition("=")[2]), {})
            if info.path not in known:
                known[info.path] = list(self._footer(files, info.path))

    @staticmethod
    def _footer(files: pyarrow.fs.FileSystem, file: str) -> Iterator[Piece]:
        footer = pq.read_metadata(file, filesystem=files)
        column = footer.schema.names.index("offset")
        for k in range(footer.num_row_groups):
            group = footer.row_group(k)
            if group.num_rows:
                range_ = group.column(column).statistics
                yield Piece(file, k, range_.min, range_.max, group.total_byte_size)

    def _after(self, partition: int, start: int) -> list[Piece]:
        every = (piece for pieces in self.pieces.get(partition, {}).values() for piece in pieces)
        return sorted((p for p in every if p.last >= start), key=lambda p: (p.first, p.file, p.group))

    def _next(self, partition: int, start: int, room: float) -> int:
        for piece in self._after(partition, start):
            if room <= 0:
                break
            end = piece.upto(start, room)
            room -= piece.size * (end - max(start, piece.first)) / (piece.last - piece.first + 1)
            start = end
        return start

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if any(end.get(p, 0) < position for p, position in start.items()):
            # The group's file was behind the query's checkpoint; from here on it is not.
            self.commit(start)
            raise ValueError("the committed position was behind the checkpoint and has been set; start the query again")
        if not self.pieces:
            self._look()
        self.reached = dict(end)
        return [
            Slice(int(p), piece.file, piece.group, max(start.get(p, 0), piece.first), min(position, piece.last + 1))
            for p, position in end.items()
            for piece in self._after(int(p), start.get(p, 0))
            if piece.first < position
        ]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        with pq.ParquetFile(partition.file, filesystem=files) as file:
            columns = ["key", "value", "offset", "timestamp"]
            for batch in file.iter_batches(row_groups=[partition.group], columns=columns):
                offset = batch.column("offset")
                inside = pc.and_(pc.greater_equal(offset, partition.first), pc.less(offset, partition.end))
                batch = batch.filter(inside)
                if batch.num_rows:
                    number = pa.array([partition.partition] * batch.num_rows, pa.int32())
                    times = batch.column("timestamp").cast(pa.timestamp("us", "UTC"))
                    cells = [batch.column("key"), batch.column("value"), number, batch.column("offset"), times]
                    yield pa.RecordBatch.from_arrays(cells, names=["key", "value", "partition", "offset", "timestamp"])

    def commit(self, end: dict) -> None:
        if self.group:
            files, path = _opened(self._group_file())
            files.create_dir(os.path.dirname(path), recursive=True)
            with files.open_output_stream(path) as stream:
                stream.write(json.dumps(end).encode())

    def stop(self) -> None:
        pass


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessageLogReader(self.options)


def append_messages(messages: DataFrame, path: str, files: int = 1) -> None:
    """Add messages to the log, `files` or so at a time, each partition's in rising offsets.

    The log's writer numbers the messages: later calls must bring higher offsets."""
    ranged = messages.repartitionByRange(files, "partition", "offset").sortWithinPartitions("partition", "offset")
    ranged.write.mode("append").partitionBy("partition").parquet(path)


def read_message_log(
    spark: SparkSession, path: str, group: str | None = None, fetch_bytes: int = FETCH_BYTES
) -> DataFrame:
    """The log as a stream of messages. The folder must be one that pyarrow opens on every machine (a shared disk,
    hdfs, s3, gs); for others read the files with `read_message_files`."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format(NAME).option("path", path).option("fetchbytes", fetch_bytes)
    return (reader.option("group", group) if group else reader).load()


# Executors get the source with the job and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
