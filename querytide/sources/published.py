"""The published top list.

Each snapshot replaces one of a few slots in turn. Readers take the newest complete snapshot; the slot being replaced
holds the oldest one, so they never see a half-written list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from querytide.functions.times import rfc3339
from querytide.operators.ranking import requested_limit, trim
from querytide.schema import SNAPSHOT, TOP
from querytide.session import no_rows

SLOTS = 16



def _ordered(data: Column) -> Column:
    """Top order for an array of (query, count)."""
    return F.array_sort(
        data,
        lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1))
        .when(a["query"] < b["query"], -1)
        .when(a["query"] > b["query"], 1)
        .otherwise(0),
    )


def envelope(top: DataFrame, updated_at: Column) -> DataFrame:
    """One row: the whole list as an array in top order, and its time. `top` is a top-k list, so the row is bounded."""
    items = F.collect_list(F.struct("query", "count"))
    return top.agg(items.alias("data")).select(_ordered(F.col("data")).alias("data"), updated_at.alias("updated_at"))


def envelope_json(top: DataFrame, updated_at: Column) -> DataFrame:
    """One row, `body`: the envelope as compact JSON."""
    whole = envelope(top, updated_at)
    return whole.select(F.to_json(F.struct("data", rfc3339(F.col("updated_at")).alias("updated_at"))).alias("body"))


def publish(top: DataFrame, path: str, snapshot_id: int, updated_at: Column) -> None:
    row = envelope(top, updated_at).select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"),
        "updated_at",
        "data",
        F.lit(snapshot_id % SLOTS).alias("slot"),
    )
    writer = row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("slot").parquet(path)


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    try:
        written = spark.read.schema(SNAPSHOT).option("ignoreMissingFiles", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        written = no_rows(spark, SNAPSHOT)
    return written.drop("slot")


def latest_id(spark: SparkSession, path: str) -> int | None:
    return _snapshots(spark, path).agg(F.max("snapshot_id")).first()[0]


def latest(spark: SparkSession, path: str, asked_at: Column | None = None) -> DataFrame:
    """The newest envelope; before the first snapshot one row with an empty list and the time asked for, now."""
    empty = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("snapshot_id"),
        (F.current_timestamp() if asked_at is None else asked_at).alias("updated_at"),
        F.array().cast(SNAPSHOT["data"].dataType).alias("data"),
    )
    newest = _snapshots(spark, path).unionByName(empty).orderBy(F.desc("snapshot_id")).limit(1)
    return newest.select("data", "updated_at")


def published_top(spark: SparkSession, path: str, n: int = 0) -> DataFrame:
    """Rows (query, count) of the newest list, the first n of them; n <= 0 means all."""
    return trim(latest(spark, path).select(F.inline("data")).to(TOP), n)


def top_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The public request: 1 to 100 rows, 50 unless given."""
    return published_top(spark, path, requested_limit(limit))


def published_json(spark: SparkSession, path: str, asked_at: Column | None = None) -> DataFrame:
    """The newest envelope as compact JSON, whole."""
    body = F.to_json(F.struct("data", rfc3339(F.col("updated_at")).alias("updated_at")))
    return latest(spark, path, asked_at).select(body.alias("body"))
