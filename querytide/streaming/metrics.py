"""Counts of every micro-batch as a table, written while the stream runs.

Spark reports what a stream has observed after each batch, outside the batch's own work. The listener writes each report to
one small file named after the batch, so a repeated batch replaces its own and totals count nothing twice.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from querytide.errors import QuerytideError
from querytide.session import no_rows
from querytide.sources.files import SharedFiles

METRICS = "batch_id bigint, metric string, value bigint, seconds double"


class BatchMetrics(StreamingQueryListener):
    """Writes the whole numbers that a query observes, under any name, to `path`, one row a metric and batch.

    Only the query named `query` is listened to. Add it with `spark.streams.addListener`."""

    def __init__(self, spark: SparkSession, path: str, query: str) -> None:
        self.files, self.query = SharedFiles(spark, path), query

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        if progress.name != self.query or not progress.observedMetrics:
            return
        seconds = (progress.durationMs.get("triggerExecution") or 0) / 1000
        rows = [
            {"batch_id": progress.batchId, "metric": metric, "value": value, "seconds": seconds}
            for observed in progress.observedMetrics.values()
            for metric, value in observed.asDict().items()
            if isinstance(value, int)
        ]
        self.files.write(f"{progress.batchId:012d}.json", "\n".join(map(json.dumps, rows)))

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all batches that a query has reported itself are written; Spark tells listeners later."""
        wanted = {f"{p.batchId:012d}.json" for p in query.recentProgress if p.observedMetrics}
        until = time.monotonic() + seconds
        while wanted - set(self.files.names()):
            if time.monotonic() > until:
                raise QuerytideError("the listener has not been told of all batches")
            time.sleep(0.1)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def batch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, metric, value, seconds) of the batches reported so far."""
    if not SharedFiles(spark, path).names():
        return no_rows(spark, T.StructType.fromDDL(METRICS))
    return spark.read.schema(METRICS).json(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value): the sums over all batches."""
    return batch_metrics(spark, path).groupBy("metric").agg(F.sum("value").alias("value"))
