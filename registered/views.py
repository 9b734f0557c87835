"""Search events and messages, derived from the given tables. Every event becomes one search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.settings import Settings

# Events are minutes apart, so the durations are hours where a live system would have seconds.
HOUR, DAY = 3_600, 86_400
SETTINGS = Settings(rate_limit=3, rate_ttl=DAY, bucket=HOUR, window=DAY, tick=HOUR, top_limit=1000)
STOP_WORDS = (" Red ", "hot plate", "   ", "RED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, query, user_id, ip, arrived): the events as searches, before any field is late or damaged.

    The query text goes through the parts in turn. One address makes a third of the searches, some have none.
    """
    part = table(spark, sf_dir, "part")
    parts = part.agg(F.count("*")).scalar()
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("query"))
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("arrived")
    )
    block = F.call_function("div", F.col("user_id"), F.lit(256))
    ip = (
        F.when(F.col("event_id") % 17 == 0, "")
        .when(F.col("event_id") % 3 == 0, "203.0.113.7")
        .otherwise(F.concat(F.lit("10.0."), block, F.lit("."), F.col("user_id") % 256))
    )
    return events.join(texts, F.col("event_id") % parts == F.col("p_partkey")).select(
        F.col("event_id").alias("seq"),
        "query",
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        ip.alias("ip"),
        "arrived",
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, query, user_id, ip, arrival, timestamp) with one event in ten two days late and one an hour late."""
    arrival = F.unix_seconds("arrived")
    late = F.when(F.col("seq") % 10 == 0, 200_000).when(F.col("seq") % 10 == 1, 4_000).otherwise(0)
    return searches(spark, sf_dir).select(
        "seq", "query", "user_id", "ip", arrival.alias("arrival"), (arrival - late).alias("timestamp")
    )


def as_of(events: DataFrame):
    """The latest arrival, as a scalar subquery."""
    return events.agg(F.max("arrival")).scalar()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): the events as JSON, with thirteen kinds of unusual payload among every fifty."""
    good = F.to_json(F.struct("query", "user_id", "ip", "timestamp"))
    kind = F.col("seq") % 50
    payload = (
        F.when(kind == 1, "")
        .when(kind == 2, "not json")
        .when(kind == 3, '{"query":5,"ip":"10.9.9.9","timestamp":7}')
        .when(kind == 4, '{"query":"half","timestamp":1.5}')
        .when(kind == 5, "null")
        .when(kind == 6, '{"query":"only a query","page":2}')
        .when(kind == 7, '{"query":null,"user_id":"u","ip":null,"timestamp":null}')
        .when(kind == 8, '{"query":"before time","timestamp":-1}')
        .when(kind == 9, F.concat(good, F.lit(" and more")))
        .when(kind == 10, F.concat(good, good))
        .when(kind == 11, F.concat(good, F.lit(" "), good))
        .when(kind == 12, '{"query":"a"},{"b":1}')
        .when(kind == 13, '{"query":"a"}}')
        .otherwise(good)
    )
    return search_events(spark, sf_dir).select("seq", payload.cast("binary").alias("value"))


def kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in the shape of a Kafka source, in three partitions."""
    late = F.when(F.col("seq") % 10 == 0, 200_000).when(F.col("seq") % 10 == 1, 4_000).otherwise(0)
    event = F.struct("query", "user_id", "ip", (F.unix_seconds("arrived") - late).alias("timestamp"))
    return searches(spark, sf_dir).select(
        F.col("ip").cast("binary").alias("key"),
        F.to_json(event).cast("binary").alias("value"),
        (F.col("seq") % 3).cast("int").alias("partition"),
        F.col("seq").alias("offset"),
        F.col("arrived").alias("timestamp"),
    )
