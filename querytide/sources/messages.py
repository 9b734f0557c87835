"""Messages: reading them, decoding search events, keeping what cannot be decoded, and writing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytide.schema import MESSAGE, SEARCH_EVENT

# Fixed value: largest fetch from the broker, in bytes.
MAX_FETCH_BYTES = 10_000_000

_RAW = "_raw"
_READ = T.StructType(
    [T.StructField(f.name, T.VariantType() if f.name == "timestamp" else f.dataType) for f in SEARCH_EVENT.fields]
)


def kafka_options(brokers: list[str], topic: str, group: str | None = None, max_offsets: int | None = None) -> dict:
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "kafka.fetch.max.bytes": str(MAX_FETCH_BYTES),
    }
    if group:
        options["kafka.group.id"] = group
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_kafka(spark: SparkSession, streaming: bool = True, **connection) -> DataFrame:
    """Messages of a topic. Needs Spark's Kafka connector on the class path; offsets live in the checkpoint."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**kafka_options(**connection)).load()


def read_message_files(spark: SparkSession, path: str, streaming: bool = True, files_per_trigger: int | None = None):
    """Messages archived as Parquet files in the shape a Kafka source delivers."""
    if not streaming:
        return spark.read.schema(MESSAGE).parquet(path)
    reader = spark.readStream.schema(MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _wrong_types(payload: Column) -> Column:
    """True where a field holds another JSON type than its own, or a key is repeated."""
    parsed = F.try_parse_json(payload)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))

    wrong = parsed.isNull()
    for field in SEARCH_EVENT:
        wanted = "BIGINT" if isinstance(field.dataType, T.LongType) else "STRING"
        wrong = wrong | ~F.coalesce(kind(f"$.{field.name}"), F.lit("VOID")).isin(wanted, "VOID")
    return wrong


def parse(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Add `event`, the decoded struct, and `bad_reason`, null where the payload is a usable event.

    Spark's JSON reader turns a number or an object into text where text is wanted. `strict` rejects those, and
    repeated keys as well; it parses every payload twice.
    """
    payload = F.col("value").cast("string")
    # Read as the only element of an array: anything but a single object then gives no element, or more than one. The
    # timestamp keeps its JSON type. The generator holds the parsed payload, so that filters on it do not parse again.
    read = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), T.ArrayType(_READ))
    parsed = messages.select(*messages.columns, F.explode_outer(F.array(read)).alias(_RAW))
    raw, given = F.get(_RAW, 0), F.schema_of_variant(F.get(_RAW, 0)["timestamp"])

    def text(name: str) -> Column:
        return F.coalesce(raw[name], F.lit("")).alias(name)

    whole = F.coalesce(given, F.lit("VOID")).isin("BIGINT", "VOID")
    time = F.when(given == "BIGINT", F.try_variant_get(raw["timestamp"], "$", "bigint"))
    timestamp = F.coalesce(time, F.lit(0).cast("bigint")).alias("timestamp")
    single = F.coalesce((F.size(_RAW) == 1) & raw.isNotNull(), F.lit(False))
    bad = F.when(~single | ~whole, "not_an_event")
    if strict:
        bad = bad.when(_wrong_types(payload), "wrong_type")
    bad = bad.when(timestamp < 0, "negative_timestamp")
    return parsed.select(
        *messages.columns,
        F.struct(text("query"), text("user_id"), text("ip"), timestamp).alias("event"),
        bad.alias("bad_reason"),
    )


def decode(messages: DataFrame, strict: bool = False) -> DataFrame:
    """The usable events, one column per field, next to the message's own columns other than its payload."""
    others = [c for c in messages.columns if c not in ("key", "value", *SEARCH_EVENT.names)]
    return parse(messages, strict).where(F.col("bad_reason").isNull()).select(*others, "event.*")


def quarantine(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Messages that hold no usable event, with the reason."""
    return parse(messages, strict).where(F.col("bad_reason").isNotNull()).drop("event")


def encode(events: DataFrame) -> DataFrame:
    """Events as messages: the address is the key, the payload is JSON."""
    return events.select(
        F.col("ip").alias("key"), F.to_json(F.struct(*[F.col(name) for name in SEARCH_EVENT.names])).alias("value")
    )


def write_kafka(events: DataFrame, brokers: list[str], topic: str) -> None:
    """Write a table of events to a topic. Needs Spark's Kafka connector on the class path."""
    writer = encode(events).write.format("kafka")
    writer.option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic).save()


def arrival_millis(message_time: Column) -> Column:
    """The rate limiter's clock for messages: the broker's time in milliseconds."""
    return F.unix_millis(message_time)
