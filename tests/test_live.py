"""The live job against the batch operators."""

import datetime as dt
import random

from models import rate_verdicts
from pyspark.sql import functions as F

from querytide.operators.stoplist import normalise
from querytide.plans.trending import filtered_counts, top_of_counts
from querytide.schema import MESSAGE
from querytide.settings import Settings
from querytide.sources.messages import encode, read_message_files
from querytide.sources.published import latest, published_top
from querytide.sources.stopwords import add_stop_words, create_stop_words, words_table
from querytide.streaming.live import LiveJob
from querytide.streaming.windows import ClosedCounts

SETTINGS = Settings(rate_limit=3, rate_ttl=10, bucket=5, window=60, top_limit=5)
START = 1_700_000_000


def messages(spark, rows):
    """rows: (offset, arrival in seconds since START, ip, query, timestamp); a payload is broken where query is None."""
    source = spark.createDataFrame(rows, "offset bigint, arrival bigint, ip string, query string, timestamp bigint")
    events = source.withColumn("user_id", F.lit("u"))
    payload = F.to_json(F.struct("query", "user_id", "ip", "timestamp"))
    return events.select(
        F.col("ip").cast("binary").alias("key"),
        F.when(F.col("query").isNull(), "{broken").otherwise(payload).cast("binary").alias("value"),
        F.lit(0).alias("partition"),
        "offset",
        F.timestamp_seconds(F.col("arrival") + START).alias("timestamp"),
    ).to(MESSAGE)


def traffic(seed, n):
    rng, rows, clock = random.Random(seed), [], 0
    for offset in range(n):
        clock += rng.choice([0, 0, 1])
        ip = "hot" if rng.random() < 1 / 3 else rng.choice(["", "a", "b", "c", "d"])
        query = None if rng.random() < 0.05 else rng.choice(["go", "rust", "скам", "kafka", "java"])
        rows.append((offset, clock, ip, query, START + clock - rng.choice([0, 0, 7, 90])))
    return rows


def test_stream_equals_batch(spark, folder):
    rows = traffic(1, 240)
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS, follow_arrivals=True)
    create_stop_words(spark, job.stop_words, words_table(spark, ["скам"]))
    for start in range(0, 240, 60):
        messages(spark, rows[start : start + 60]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = job.start(read_message_files(spark, f"{folder}/in", files_per_trigger=1), availableNow=True)
    query.awaitTermination()

    intake = [p["observedMetrics"]["intake"]["messages_read"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(intake) == 240 and len(intake) == 4
    assert spark.read.parquet(job.quarantine_path).count() == sum(r[3] is None for r in rows)

    good = [(o, a, ip, q, t) for o, a, ip, q, t in rows if q is not None]
    events = spark.createDataFrame(good, "seq bigint, arrival bigint, ip string, query string, timestamp bigint")
    want = filtered_counts(events, normalise(words_table(spark, ["скам"])), SETTINGS)
    columns = ["drop_reason", "bucket_start", "query"]
    got = job.counts.read(spark).groupBy(*columns).agg(F.sum("count").alias("count"))
    broken = got.where("drop_reason = 'malformed'").first()
    assert broken["count"] == 240 - len(good)
    got = got.where("drop_reason IS DISTINCT FROM 'malformed'")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns, "count").collect()))
    verdicts = rate_verdicts([(ip, a, o) for o, a, ip, _, _ in good], 3, 10)
    assert got.where("drop_reason = 'antifraud'").first()["count"] == sum(not ok for ok in verdicts.values())

    as_of = START + rows[-1][1]
    top = top_of_counts(want.where("drop_reason IS NULL"), SETTINGS, as_of)
    assert published_top(spark, job.top_path).collect() == top.collect() != []
    assert latest(spark, job.top_path).first().updated_at == dt.datetime.fromtimestamp(as_of)

    # Repeating the last batch changes nothing; a later tick lets old buckets go.
    before = [tuple(r) for r in published_top(spark, job.top_path).collect()]
    job.process(messages(spark, rows[180:]), 3)
    assert [tuple(r) for r in published_top(spark, job.top_path).collect()] == before
    job.tick(spark, as_of + 1000)
    assert published_top(spark, job.top_path).collect() == []


def test_stop_list_edit_applies_to_the_next_batch(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS, follow_arrivals=True)
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    job.process(messages(spark, [(0, 0, "a", "go", START), (1, 0, "b", "rust", START)]), 0)
    add_stop_words(spark, job.stop_words, words_table(spark, ["GO"]))
    job.process(messages(spark, [(2, 1, "a", "go", START), (3, 1, "b", "rust", START)]), 1)
    assert {tuple(r) for r in published_top(spark, job.top_path).collect()} == {("go", 1), ("rust", 2)}


def test_repeated_batch_keeps_its_stop_list_and_its_snapshot(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS, follow_arrivals=True)
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    batch = messages(spark, [(0, 0, "a", "go", START), (1, 0, "b", "rust", START)])
    job.process(batch, 0)
    add_stop_words(spark, job.stop_words, words_table(spark, ["GO"]))
    job.process(batch, 0)
    assert {tuple(r) for r in published_top(spark, job.top_path).collect()} == {("go", 1), ("rust", 1)}
    job.tick(spark, START + 1)
    ids = [r[0] for r in spark.read.parquet(job.top_path).select("snapshot_id").collect()]
    assert sorted(ids) == [0, 1, 2]  # the newest snapshot is never written over


def test_message_without_a_broker_time(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS, follow_arrivals=True)
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    batch = messages(spark, [(k, 0, "a", f"q{k}", START) for k in range(9)])
    batch = batch.withColumn("timestamp", F.when(F.col("offset") > 0, F.col("timestamp")))
    job.process(batch, 0)
    assert sum(r["count"] for r in published_top(spark, job.top_path).collect()) == SETTINGS.rate_limit
    counted = {r["drop_reason"]: r["count"] for r in job.counts.read(spark).collect()}
    assert counted["antifraud"] == 9 - SETTINGS.rate_limit


def test_list_empties_when_traffic_stops(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", Settings(bucket=1, window=4, tick=1, top_limit=5))
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    now = int(dt.datetime.now().timestamp())
    job.process(messages(spark, [(0, now - START, "a", "go", now + 8)]), 0)
    assert [tuple(r) for r in published_top(spark, job.top_path).collect()] == [("go", 1)]
    ticker = job.start_ticker(spark)
    try:
        for _ in range(120):
            ticker.awaitTermination(1)
            if not published_top(spark, job.top_path).collect():
                break
        assert published_top(spark, job.top_path).collect() == []
    finally:
        ticker.stop()


def test_closed_counts_do_not_depend_on_the_batches(spark, folder):
    rows = [(START + k * 7 % 400 - (90 if k % 10 == 0 else 0), f"q{k % 5}") for k in range(300)]
    events = spark.createDataFrame(rows, "timestamp bigint, query string")
    events.repartition(12).write.parquet(f"{folder}/in")
    found = []
    for files in (1, 100):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        job = ClosedCounts(f"{folder}/out{files}", 20, 5, 30)
        job.start(stream, availableNow=True).awaitTermination()
        buckets, windows = job.buckets(spark), job.windows(spark)
        found.append([sorted(map(tuple, t.collect())) for t in (buckets, windows)])
    assert found[0] == found[1]
    last = max(t for t, _ in rows) - 30
    assert sum(r[2] for r in found[0][0]) == sum(t // 5 * 5 + 5 <= last for t, _ in rows)


def test_rate_window_spans_batches_and_clock_never_runs_back(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS, follow_arrivals=True)
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    # Two events at 0; then at the same second two more, of which one passes; then one that claims to be earlier.
    job.process(messages(spark, [(0, 0, "a", "q0", START), (1, 0, "a", "q0", START)]), 0)
    job.process(messages(spark, [(2, 0, "a", "q1", START), (3, 0, "a", "q2", START)]), 1)
    job.process(messages(spark, [(4, -5, "a", "q3", START)]), 2)
    job.process(messages(spark, [(5, 10, "a", "q4", START), (6, 11, "a", "q5", START)]), 3)
    got = {tuple(r) for r in published_top(spark, job.top_path).collect()}
    assert got == {("q0", 2), ("q1", 1), ("q5", 1)}
    # No messages at all.
    job.process(messages(spark, [(0, 0, "a", "x", START)]).limit(0), 4)
    assert {tuple(r) for r in published_top(spark, job.top_path).collect()} == got


def test_encoded_events_flow_through(spark, folder):
    job = LiveJob(f"{folder}/job", f"{folder}/stop", SETTINGS)
    create_stop_words(spark, job.stop_words, words_table(spark, []))
    now = int(dt.datetime.now().timestamp())
    events = spark.createDataFrame([("go", "u", "", now)], "query string, user_id string, ip string, timestamp bigint")
    encoded = encode(events).select(
        F.col("key").cast("binary"),
        F.col("value").cast("binary"),
        F.lit(0).alias("partition"),
        F.lit(0).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
    job.process(encoded, 0)
    assert [tuple(r) for r in published_top(spark, job.top_path).collect()] == [("go", 1)]
