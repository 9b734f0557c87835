"""Table shapes. Nothing is inferred from data."""

from pyspark.sql import types as T

# The JSON payload of one search event. A missing or null field means "" or 0.
SEARCH_EVENT = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

# A message as a Kafka source delivers it; file sources are brought to the same shape.
MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

STOP_WORDS = T.StructType([T.StructField("word", T.StringType())])

TOP = T.StructType([T.StructField("query", T.StringType()), T.StructField("count", T.LongType())])

# One published top list; `slot` is the folder it lives in.
SNAPSHOT = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("data", T.ArrayType(TOP)),
        T.StructField("slot", T.IntegerType()),
    ]
)

# Counts of one micro-batch. Messages dropped before the stop list have neither bucket nor query.
BATCH_COUNTS = T.StructType(
    [
        T.StructField("drop_reason", T.StringType()),
        T.StructField("bucket_start", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

BUCKET_COUNTS = T.StructType(BATCH_COUNTS.fields[1:])

# Changes of a query's window count at a window end.
CHANGES = T.StructType(
    [T.StructField("query", T.StringType()), T.StructField("tick", T.LongType()), T.StructField("delta", T.LongType())]
)

# Rate-limit windows of one micro-batch.
RATE_WINDOWS = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField(
            "cut", T.StructType([T.StructField("arrival", T.LongType()), T.StructField("keep", T.LongType())])
        ),
    ]
)

# Counts of the generation that each slot of a ring holds.
RING = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("generation", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
