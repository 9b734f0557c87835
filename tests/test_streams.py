"""Keyed state, the ring, closed windows, retention, the message log and metrics, across batches and restarts."""

import json
import random
import threading
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from models import rate_verdicts, ring_counts
from pyspark.sql import functions as F

from querytide.errors import QuerytideError
from querytide.operators.sliding import _contenders, window_runs
from querytide.schema import BATCH_COUNTS, MESSAGE
from querytide.sources.countstore import CountStore
from querytide.sources.files import SharedFiles, VersionLog
from querytide.sources.messagelog import MessageLogReader, append_messages, read_message_log
from querytide.sources.stopwords import (
    add_stop_words,
    create_stop_words,
    current_version,
    delete_stop_words,
    expire_stop_words,
    read_stop_words,
    words_table,
)
from querytide.streaming import limits
from querytide.streaming.metrics import BatchMetrics, batch_metrics, totals
from querytide.streaming.ring import RingJob
from querytide.streaming.windows import ClosedCounts
from registered import queries
from registered.oracles import ORACLES
from registered.queries import QUERIES, _batch_files

EVENTS = "seq bigint, ip string, arrival bigint"


# The rate limit as keyed state


@pytest.mark.parametrize("seed", range(5))
def test_judged_in_pieces_equals_the_model(seed):
    rng = random.Random(seed)
    ttl, limit = rng.randrange(1, 9), rng.randrange(1, 5)
    arrivals = sorted(rng.randrange(60) for _ in range(200))
    want = rate_verdicts([("a", t, k) for k, t in enumerate(arrivals)], limit, ttl)
    got, anchor, n, at = [], None, 0, 0
    while at < len(arrivals):
        end = at + rng.randrange(1, 40)
        passed, anchor, n = limits.judged(np.array(arrivals[at:end]), limit, ttl, anchor, n)
        got += passed.tolist()
        at = end
    assert got == [want[k] for k in range(len(arrivals))]


def test_keyed_limit_over_batches_and_a_restart(spark, folder):
    rng, rows, clock = random.Random(3), [], 0
    for seq in range(180):
        clock += rng.choice([0, 1, 1, 2])
        rows.append((seq, "hot" if seq % 3 == 0 else rng.choice(["", "a", "b", None]), clock))
    for start in (0, 90):
        for at in range(start, start + 90, 30):
            spark.createDataFrame(rows[at : at + 30], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = limits.with_rate_verdict(stream, 3, 10).writeStream.format("parquet").option("path", f"{folder}/out")
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.rate_ok for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == rate_verdicts([(ip or "", t, seq) for seq, ip, t in rows], 3, 10)
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_state_has_no_more_partitions_than_cores(spark, folder):
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(k, f"a{k % 30}", k) for k in range(120)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    spark.conf.set(name, "9")
    try:
        stream = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
        out = limits.with_rate_verdict(stream, 3, 1000).writeStream.format("parquet").option("path", f"{folder}/out")
        out = out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        with limits.few_state_partitions(spark):
            query = out.start()
        query.awaitTermination()
        assert spark.conf.get(name) == "9"
    finally:
        spark.conf.set(name, before)
    cores = spark.sparkContext.defaultParallelism
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == min(9, cores)
    got = {r.seq: r.rate_ok for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == rate_verdicts([(ip, t, seq) for seq, ip, t in rows], 3, 1000)


def test_an_overtaken_event_counts_with_the_last_one(spark, folder):
    for batch in ([(0, "a", 100), (1, "a", 105)], [(2, "a", 50), (3, "a", 111)]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = limits.with_rate_verdict(stream, 2, 10).writeStream.format("parquet").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.rate_ok for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


@pytest.mark.parametrize("seed", range(4))
def test_judged_together_equals_the_model(seed):
    """Sixty addresses, some with many windows, in batches of which few addresses miss one."""
    rng = random.Random(seed)
    ttl, limit = rng.randrange(1, 9), rng.choice([1, 2, 4, 1 << 70])
    times = sorted(rng.randrange(200) for _ in range(1500))
    rows = [(f"a{min(rng.randrange(80), 59)}", t, k) for k, t in enumerate(times)]
    anchors, counts, got = np.zeros(60, dtype=np.int64), np.zeros(60, dtype=np.int64), {}
    for at in range(0, 1500, 500):
        batch = sorted((int(ip[1:]), t, k) for ip, t, k in rows[at : at + 500])
        codes, starts = np.unique([ip for ip, _, _ in batch], return_index=True)
        anchor, n = anchors[codes], counts[codes]
        passed = limits.judged_together(starts, np.array([t for _, t, _ in batch]), limit, ttl, anchor, n)
        anchors[codes], counts[codes] = anchor, n
        got |= {k: bool(ok) for (_, _, k), ok in zip(batch, passed, strict=True)}
    assert got == rate_verdicts(rows, limit, ttl)


def test_python_runs_for_groups_of_addresses(spark, folder):
    """Two thousand addresses, of which each batch has most, are no more than the groups they are put into."""
    rng = random.Random(5)
    rows = [(k, f"a{rng.randrange(2000) if k % 3 else 0}", k // 4) for k in range(9000)]
    for start in (0, 6000):
        for at in range(start, min(start + 6000, 9000), 3000):
            spark.createDataFrame(rows[at : at + 3000], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = limits.with_rate_verdict(stream, 2, 700).writeStream.format("parquet").option("path", f"{folder}/out")
        query = out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 512
    got = {r.seq: r.rate_ok for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == rate_verdicts([(ip, t, seq) for seq, ip, t in rows], 2, 700)


class Kept:
    """A group's state, as Spark keeps it, with a clock that the test sets."""

    def __init__(self):
        self.value, self.now, self.due, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, millis):  # noqa: N802
        self.due = self.now + millis

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now


def test_addresses_of_a_group_are_forgotten_one_by_one():
    state, run = Kept(), limits._state_function(1, 10_000, ("seq",), "ip", "arrival", "rate_ok", 100, 4)

    def send(now, *ips):
        state.now, state.hasTimedOut = now, not ips
        rows = [(k, ip, now, 0) for k, ip in enumerate(ips)]
        frame = pd.DataFrame(rows, columns=["seq", "ip", "arrival", limits._GROUP])
        out = list(run((0,), [frame], state))
        return out[0].set_index("ip")["rate_ok"].to_dict() if out else {}

    assert send(0, "a", "b") == {"a": True, "b": True}
    assert send(60, "b", "c") == {"b": False, "c": True}
    assert state.due == 100
    # Nothing of "a" for more than 100 ms; "b" and "c" are still known.
    assert send(101) == {}
    assert state.due == 160
    assert send(150, "a", "b") == {"a": True, "b": False}
    # "c" is forgotten along with a batch of others, but not by a batch of its own.
    assert send(161, "a") == {"a": False}
    assert send(162, "c") == {"c": True}
    assert send(300, "c") == {"c": False}
    assert send(401) == {}
    assert not state.exists


def test_a_checkpoint_keeps_its_number_of_groups():
    state, rows = Kept(), pd.DataFrame({"seq": [1], "ip": ["a"], "arrival": [1], limits._GROUP: [0]})

    def run(groups):
        return list(limits._state_function(1, 10, ("seq",), "ip", "arrival", "rate_ok", 100, groups)((0,), [rows], state))

    run(4)
    with pytest.raises(ValueError, match="began with 4 groups"):
        run(5)


def test_tasks_can_share_a_message_file(spark, folder, monkeypatch):
    spark.range(6000).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id % 300 AS user_id"
    ).write.parquet(f"{folder}/events.parquet")
    spark.range(20).selectExpr(
        "id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand"
    ).write.parquet(f"{folder}/part.parquet")
    monkeypatch.setattr(queries, "ROW_GROUP_BYTES", 1 << 15)
    queries._message_files(spark, folder, f"{folder}/messages", 1)
    (file,) = SharedFiles(spark, f"{folder}/messages").names()
    assert pq.ParquetFile(f"{folder}/messages/{file}").num_row_groups > 3
    assert spark.read.parquet(f"{folder}/messages").agg(F.count_distinct("offset")).first()[0] == 6000


# The ring


@pytest.mark.parametrize("seed", range(3))
def test_ring_over_batches_equals_the_model(spark, folder, seed):
    rng, clock, rows = random.Random(seed), 1000, []
    for seq in range(200):
        clock += rng.randrange(4)
        rows.append((seq, f"q{rng.randrange(4)}", clock - rng.choice([0, 0, 0, 9, 70]) + (40 if seq % 61 == 60 else 0)))
    job = RingJob(f"{folder}/ring", 30, 5)
    for k, at in enumerate(range(0, 200, 50)):
        batch = spark.createDataFrame(rows[at : at + 50], "seq bigint, query string, timestamp bigint")
        job.process(batch, k)
        if k == 2:
            job.process(batch, k)  # a repeated batch changes nothing
        as_of = clock if at == 150 else rows[at + 49][2]
        got = {r["query"]: r["count"] for r in job.snapshot(spark, as_of).collect()}
        assert got == ring_counts([(q, t) for _, q, t in rows[: at + 50]], as_of, 30, 5)
    assert RingJob(f"{folder}/none", 30, 5).snapshot(spark, 0).collect() == []


# Closed windows


def windows_of(rows, window, bucket, upto):
    out = {}
    for t, q in rows:
        for end in range(t // bucket * bucket + bucket, t // bucket * bucket + window + 1, bucket):
            if end <= upto:
                out[end, q] = out.get((end, q), 0) + 1
    return out


def test_closed_windows_take_very_late_events(spark, folder):
    """Events later than the lateness correct windows that were closed before."""
    rng, job = random.Random(8), ClosedCounts(f"{folder}/job", 20, 5, 10)
    rows, clock = [], 5000
    for k in range(6):
        batch = []
        for _ in range(40):
            clock += rng.randrange(3)
            batch.append((clock - rng.choice([0, 0, 8, 31, 200]), f"q{rng.randrange(3)}"))
        rows += batch
        frame = spark.createDataFrame(batch, "timestamp bigint, query string")
        job.process(frame, k)
        if k == 3:
            job.process(frame, k)
        upto = (max(t for t, _ in rows) - 10) // 5 * 5
        assert job.closed_upto(spark) == upto
        got = {(r["window_end"], r["query"]): r["count"] for r in job.windows(spark).collect()}
        assert got == windows_of(rows, 20, 5, upto)
    job.process(spark.createDataFrame([], "timestamp bigint, query string"), 6)
    assert {(r["window_end"], r["query"]): r["count"] for r in job.windows(spark).collect()} == got
    recent = upto - 40
    want = {k: n for k, n in got.items() if k[0] > recent}
    job.tidy(spark, expired=recent)
    assert {(r["window_end"], r["query"]): r["count"] for r in job.windows(spark, after=recent).collect()} == want


def test_closed_windows_are_read_and_not_rebuilt(spark, folder):
    job = ClosedCounts(f"{folder}/job", 300, 5, 10)
    job.process(spark.createDataFrame([(5000 + k, "q") for k in range(400)], "timestamp bigint, query string"), 0)
    plan = job.windows(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan.replace("window_end", "")


# Retention


def counts_of(rows):
    out = {}
    for r in rows.collect():
        key = (r["drop_reason"], r["bucket_start"], r["query"])
        out[key] = out.get(key, 0) + r["count"]
    return out


def test_counts_after_compaction_and_expiry(spark, folder):
    store = CountStore(f"{folder}/counts", BATCH_COUNTS, 100)
    assert store.read(spark).collect() == [] and not store.compact(spark)
    for k in range(6):
        rows = [(None, 1000 + 50 * k, "q", 1), (None, 1000, "late", 2), ("antifraud", None, None, 3)]
        written = store.write(spark.createDataFrame(rows, BATCH_COUNTS), k)
        assert sorted(map(str, written.collect())) == sorted(map(str, spark.createDataFrame(rows, BATCH_COUNTS).collect()))
    whole, live = counts_of(store.read(spark)), counts_of(store.read(spark, after=1100))
    early = store.read(spark)  # planned on the version before
    assert store.compact(spark)
    assert counts_of(store.read(spark)) == whole and counts_of(early) == whole
    assert store.read(spark).count() < 6 * 3
    for k in (6, 7):
        store.write(spark.createDataFrame([(None, 1000 + 50 * k, "q", 1)], BATCH_COUNTS), k)
        live[None, 1000 + 50 * k, "q"] = 1
    between = store.read(spark)
    assert store.compact(spark, expired=1100)
    assert counts_of(store.read(spark, after=1100)) == live
    assert counts_of(between)[None, 1000, "late"] == 12  # its files are still there
    assert {k for k in counts_of(store.read(spark)) if k[1] is not None and k[1] <= 1100} == set()
    assert counts_of(store.read(spark))["antifraud", None, None] == 18
    assert store.batch_ids(spark) == [5, 6, 7]  # the first compaction's batches are gone
    store.write(spark.createDataFrame([(None, 1400, "q", 1)], BATCH_COUNTS), 8)
    assert store.compact(spark, expired=1200) and len(SharedFiles(spark, f"{store.path}/bases").names()) == 2


def test_a_read_of_recent_buckets_prunes_partitions(spark, folder):
    store = CountStore(f"{folder}/counts", BATCH_COUNTS, 100)
    for k in range(2):
        rows = [(None, 100 * j, "q", 1) for j in range(50)]
        store.write(spark.createDataFrame(rows, BATCH_COUNTS), k)
    plan = store.read(spark, after=4700)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and "(span" in plan
    read = store.read(spark, after=4700).select(F.input_file_name().alias("file")).distinct().collect()
    assert {r.file.split("span=")[1].split("/")[0] for r in read} == {"48", "49"}


# Editors


def test_editors_at_the_same_time_lose_no_word(spark, folder):
    path = f"{folder}/stop"
    create_stop_words(spark, path, words_table(spark, [f"old{k}" for k in range(6)]))
    with pytest.raises(QuerytideError):
        create_stop_words(spark, path, words_table(spark, []))
    start, failed = threading.Barrier(3), []

    def edits(change, names):
        start.wait()
        try:
            for name in names:
                change(spark, path, words_table(spark, [name]))
        except Exception as error:
            failed.append(error)

    parts = [(add_stop_words, [f"a{k}" for k in range(4)]), (add_stop_words, [f"b{k}" for k in range(4)]), (delete_stop_words, [f"old{k}" for k in range(4)])]
    threads = [threading.Thread(target=edits, args=part) for part in parts]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed and current_version(spark, path) == 13
    want = {f"{x}{k}" for x in "ab" for k in range(4)} | {"old4", "old5"}
    assert {r.word for r in read_stop_words(spark, path).collect()} == want
    assert expire_stop_words(spark, path, keep=3, older_than_millis=0) == 10
    assert {r.word for r in read_stop_words(spark, path).collect()} == want
    assert read_stop_words(spark, path, 11).count() > 0
    with pytest.raises(QuerytideError):
        read_stop_words(spark, path, 2)
    assert len(SharedFiles(spark, f"{path}/words").names()) == 3


def test_two_editors_of_the_same_words(spark, folder):
    # Every brand has every name, so the first edit deletes all that the later ones name.
    rows = [(f"name {k % 5}", f"Brand#1{k % 4}", 1 + k % 10) for k in range(60)]
    rows += [(f"name {k}", "Brand#11", 15 + 10 * (k % 3)) for k in range(3, 9)] + [("kept", "Brand#14", 2)]
    parts = spark.createDataFrame(rows, "p_name string, p_brand string, p_size int")
    parts.write.parquet(f"{folder}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    want = duck.execute(ORACLES["stopwords_two_editors"]).fetchall()
    got = [tuple(r) for r in QUERIES["stopwords_two_editors"](spark, folder).collect()]
    assert sorted(got) == sorted(want)
    assert ("kept",) in got


def test_a_version_is_claimed_once(spark, folder):
    log = VersionLog(spark, f"{folder}/log")
    assert log.newest() is None and log.claim(1, "first") and not log.claim(1, "second")
    assert log.read(1) == "first" and log.versions() == [1] and log.read(2) is None
    won, barrier = [], threading.Barrier(8)

    def claim(k):
        barrier.wait()
        if log.claim(2, str(k)):
            won.append(k)

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(won) == 1 and log.read(2) == str(won[0])


# The message log


def log_messages(spark, first, last):
    rows = [(b"k", json.dumps({"query": f"q{o}"}).encode(), o % 3, o, None) for o in range(first, last)]
    return spark.createDataFrame(rows, MESSAGE)


def test_fetches_are_bounded_and_positions_go_on(spark, folder):
    append_messages(log_messages(spark, 0, 300), f"{folder}/log", files=2)
    options = {"path": f"{folder}/log", "group": "g", "fetchbytes": "2000"}
    reader, start, seen = MessageLogReader(options), {}, []
    assert reader.initialOffset() == {}
    for turn in range(200):
        end = reader.latestOffset()
        if end == start:
            break
        rows = [r for s in reader.partitions(start, end) for b in reader.read(s) for r in b.to_pylist()]
        assert 0 < len(rows) < 150 and sum(len(r["value"]) for r in rows) <= 2000
        seen += [(r["partition"], r["offset"]) for r in rows]
        start = end
        reader.commit(end)
        if turn == 3:
            reader = MessageLogReader(options)  # a new process goes on from the group's file
    assert sorted(seen) == sorted((o % 3, o) for o in range(300)) and turn > 4
    append_messages(log_messages(spark, 300, 310), f"{folder}/log")
    assert sum(len(b) for s in reader.partitions(start, reader.latestOffset()) for b in reader.read(s)) == 10
    with pytest.raises(ValueError):
        reader.partitions(start, {"0": 1, "1": 1, "2": 1})
    assert MessageLogReader(options).initialOffset() == start


def test_a_stream_of_the_log_resumes(spark, folder):
    append_messages(log_messages(spark, 0, 200), f"{folder}/log", files=3)

    def write(batch, batch_id):
        batch.select("partition", "offset").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    def run():
        stream = read_message_log(spark, f"{folder}/log", "g", fetch_bytes=300)
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(processingTime="0 seconds").start()

    first = run()
    while first.isActive and len(first.recentProgress) < 1:
        first.awaitTermination(1)
    first.stop()
    assert spark.read.parquet(f"{folder}/out").count() < 200
    append_messages(log_messages(spark, 200, 260), f"{folder}/log")
    second = run()
    second.processAllAvailable()
    second.stop()
    got = [(r["partition"], r["offset"]) for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(got) == sorted((o % 3, o) for o in range(260))


# Metrics


def test_metrics_of_every_batch(spark, folder):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert batch_metrics(spark, f"{folder}/metrics").collect() == []
    listener = BatchMetrics(spark, f"{folder}/metrics", "counted")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        stream = stream.observe("seen", F.count("*").alias("rows"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        writer = stream.writeStream.queryName("counted").format("noop")
        query = writer.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    rows = batch_metrics(spark, f"{folder}/metrics").collect()
    assert sorted((r.batch_id, r.metric, r.value) for r in rows) == [(k, m, n) for k in range(3) for m, n in (("even", 5), ("rows", 10))]
    assert {tuple(r) for r in totals(spark, f"{folder}/metrics").collect()} == {("rows", 30), ("even", 15)}


# Top lists of ticks


def test_ticks_are_expanded_for_contenders_only(spark):
    """Of 500 queries with one event now and then and 5 frequent ones, the rare ones are cut as runs."""
    rng = random.Random(2)
    rows = [(5 * b, f"top{q}", 50 + q) for b in range(400) for q in range(5)]
    rows += [(5 * rng.randrange(400), f"rare{q}", 1) for q in range(500)]
    counts = spark.createDataFrame(rows, "bucket_start bigint, query string, count bigint")
    runs = window_runs(counts, 300, 5)
    kept = _contenders(runs, 300, 5, 3).groupBy("query").count().collect()
    assert runs.where("query LIKE 'rare%'").count() >= 500
    # Only the window's first and last spells, in which nobody is there throughout, keep them.
    assert sum(r["count"] for r in kept if r["query"].startswith("rare")) < 150


@pytest.mark.parametrize("cores", [1, 3, 8, 12, 100])
def test_cores_get_equally_many_files_of_a_micro_batch(cores):
    context = SimpleNamespace(defaultParallelism=cores)
    files = _batch_files(SimpleNamespace(sparkContext=context))
    assert files >= 8 and files % cores == 0
