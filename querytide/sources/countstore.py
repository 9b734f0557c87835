"""Counts that a stream adds batch by batch, as one table that is compacted and expired while others read it.

A batch is a folder, and repeating a batch overwrites its own. Within a folder rows are partitioned by stretches of bucket
time, so a read of recent buckets opens no others. `compact` sums up finished batches into one base folder without expired
buckets, and claims the next version of the log for it. It deletes what the version before the present one had
replaced, so a reader that has planned on the present version still finds its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.functions.times import as_column, cell
from querytide.session import no_rows
from querytide.sources.files import SharedFiles, VersionLog

_SPAN = "span"
_EMPTY = {"folder": None, "upto": -1}


@dataclass(frozen=True)
class CountStore:
    """`schema` has a column bucket_start, which may be null, and a column count; the other columns are keys too.
    `span` is the stretch of bucket time of one partition, in seconds."""

    path: str
    schema: T.StructType
    span: int

    def _log(self, spark: SparkSession) -> VersionLog:
        return VersionLog(spark, f"{self.path}/log")

    def _batches(self, spark: SparkSession) -> SharedFiles:
        return SharedFiles(spark, f"{self.path}/batches")

    def _current(self, spark: SparkSession) -> tuple[int, dict]:
        newest = self._log(spark).newest()
        return (0, _EMPTY) if newest is None else (newest, json.loads(self._log(spark).read(newest)))

    def _partitioned(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, cell(F.col("bucket_start"), self.span).alias(_SPAN))

    def _folders(self, spark: SparkSession, base: str, folders: Sequence[str]) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(_SPAN, T.LongType())])
        if not folders:
            return no_rows(spark, stored)
        reader = spark.read.schema(stored).option("basePath", f"{self.path}/{base}")
        return reader.parquet(*[f"{self.path}/{base}/{name}" for name in folders]).select(*stored.names)

    def batch_ids(self, spark: SparkSession) -> list[int]:
        """Batches that are there as folders of their own."""
        return sorted(int(name.partition("=")[2]) for name in self._batches(spark).names())

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's rows and return them as read from storage."""
        folder = f"batch_id={batch_id}"
        self._partitioned(rows).write.mode("overwrite").partitionBy(_SPAN).parquet(f"{self.path}/batches/{folder}")
        return self._folders(rows.sparkSession, "batches", [folder]).drop(_SPAN)

    def read(self, spark: SparkSession, after: Column | int | None = None) -> DataFrame:
        """The rows of all batches; with `after`, those of later buckets only. One key may have several rows."""
        _, current = self._current(spark)
        recent = [f"batch_id={i}" for i in self.batch_ids(spark) if i > current["upto"]]
        bases = [current["folder"]] if current["folder"] else []
        rows = self._folders(spark, "bases", bases).unionByName(self._folders(spark, "batches", recent))
        if after is not None:
            bound = as_column(after)
            # The first condition is implied by the second; it picks the partitions.
            rows = rows.where((F.col(_SPAN) >= cell(bound, self.span)) & (F.col("bucket_start") > bound))
        return rows.drop(_SPAN)

    def compact(self, spark: SparkSession, expired: int | None = None) -> bool:
        """Sum up the batches but the newest, which may yet be repeated, without buckets up to `expired`. Rows without
        a bucket are kept. False where nothing is to do or somebody else compacts at the same time."""
        version, current = self._current(spark)
        ids = self.batch_ids(spark)
        done = [i for i in ids[:-1] if i > current["upto"]]
        if not done:
            return False
        bases = [current["folder"]] if current["folder"] else []
        recent = self._folders(spark, "batches", [f"batch_id={i}" for i in done])
        rows = self._folders(spark, "bases", bases).unionByName(recent)
        if expired is not None:
            rows = rows.where(F.col("bucket_start").isNull() | (F.col("bucket_start") > expired))
        keys = [name for name in self.schema.names if name != "count"]
        summed = rows.groupBy(*keys).agg(F.sum("count").alias("count"))
        folder = uuid.uuid4().hex
        self._partitioned(summed).write.partitionBy(_SPAN).parquet(f"{self.path}/bases/{folder}")
        if not self._log(spark).claim(version + 1, json.dumps({"folder": folder, "upto": done[-1]})):
            SharedFiles(spark, f"{self.path}/bases").delete(folder)
            return False
        self._forget_before(spark, version, current)
        return True

    def _forget_before(self, spark: SparkSession, version: int, current: dict) -> None:
        """Delete what `current`, the version before the newest, does not read."""
        for i in self.batch_ids(spark):
            if i <= current["upto"]:
                self._batches(spark).delete(f"batch_id={i}")
        for old in self._log(spark).versions():
            if old < version:
                SharedFiles(spark, f"{self.path}/bases").delete(json.loads(self._log(spark).read(old))["folder"])
                self._log(spark).forget(old)
