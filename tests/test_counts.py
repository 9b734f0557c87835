import random
from collections import Counter

import pytest
from models import ring_counts
from pyspark.sql import functions as F

from querytide.errors import InvalidArgumentError
from querytide.functions.times import bucket_start, rfc3339, slot
from querytide.operators.counts import (
    bucket_counts,
    drop_counts,
    drop_rate,
    messages_read,
    snapshot_of_events,
    window_snapshot,
)
from querytide.operators.ranking import first_k_per_group, requested_limit, top_k, trim
from querytide.operators.ring import ring_snapshot
from querytide.operators.sliding import sliding_counts, tick_top
from querytide.settings import Settings

NOW = 1_700_000_003


def events(spark, rows):
    """rows: (query, timestamp) in arrival order."""
    return spark.createDataFrame(
        [(seq, query, timestamp) for seq, (query, timestamp) in enumerate(rows)],
        "seq bigint, query string, timestamp bigint",
    )


def as_dict(df):
    return {r["query"]: r["count"] for r in df.collect()}


def test_counts_across_buckets(spark):
    rows = events(spark, [("tea", NOW), *[("tea", NOW - 4)] * 2, ("honey", NOW - 9), ("milk", NOW - 13), ("milk", NOW - 3)])
    want = {"tea": 3, "honey": 1, "milk": 2}
    assert as_dict(window_snapshot(bucket_counts(rows, 5), NOW, 20)) == want
    assert as_dict(snapshot_of_events(rows, NOW, 20, 5)) == want
    assert as_dict(ring_snapshot(rows, NOW, 20, 5)) == want


def test_query_text_is_the_key_as_sent(spark):
    rows = events(spark, [("Go", NOW), ("go", NOW), (" go", NOW), ("", NOW), ("", NOW)])
    assert as_dict(snapshot_of_events(rows, NOW, 15, 5)) == {"Go": 1, "go": 1, " go": 1, "": 2}


def test_future_event_reuses_a_slot(spark):
    rows = events(spark, [("snow", NOW), ("sun", NOW + 10)])
    assert as_dict(ring_snapshot(rows, NOW, 10, 5)) == {"sun": 1}
    # Without a ring both count; the future one does not when the window is closed at its upper end.
    assert as_dict(snapshot_of_events(rows, NOW, 10, 5)) == {"snow": 1, "sun": 1}
    assert as_dict(snapshot_of_events(rows, NOW, 10, 5, until=NOW)) == {"snow": 1}
    assert as_dict(window_snapshot(bucket_counts(rows, 5), NOW, 10, until=NOW)) == {"snow": 1}


def test_late_event_counts_into_the_newer_bucket_of_its_slot(spark):
    rows = events(spark, [("new", NOW), ("late", NOW - 10)])
    assert as_dict(ring_snapshot(rows, NOW, 10, 5)) == {"new": 1, "late": 1}
    assert as_dict(snapshot_of_events(rows, NOW, 10, 5)) == {"new": 1}


def test_window_edge(spark):
    rows = events(spark, [("edge", 1000 - 15), ("in", 1000 - 10)])
    assert as_dict(window_snapshot(bucket_counts(rows, 5), 1000, 15)) == {"in": 1}
    # The ring still holds the bucket at the edge, until its slot is reused.
    assert as_dict(ring_snapshot(rows, 1000, 15, 5)) == {"edge": 1, "in": 1}


@pytest.mark.parametrize("seed", range(6))
def test_ring_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    window, bucket = rng.choice([(60, 5), (30, 10), (12, 3)])
    rows, clock = [], 10_000
    for _ in range(1500):
        clock += rng.choice([0, 0, 1, 1, 2])
        late = rng.choice([0, 0, 0, 0, rng.randrange(4 * window), -rng.randrange(2 * window)])
        rows.append((f"q{rng.randrange(6)}", max(0, clock - late)))
    got = as_dict(ring_snapshot(events(spark, rows), clock, window, bucket))
    assert got == ring_counts(rows, clock, window, bucket)


def test_many_adds(spark):
    rows = spark.range(8000).select(
        F.col("id").alias("seq"), F.lit("umbrella").alias("query"), F.lit(NOW).cast("bigint").alias("timestamp")
    )
    assert as_dict(snapshot_of_events(rows, NOW, 15, 5)) == {"umbrella": 8000}
    assert as_dict(ring_snapshot(rows, NOW, 15, 5)) == {"umbrella": 8000}


def test_most_frequent_of_many_queries(spark):
    # Every second another of 700 words, each third second the same one again.
    rows = events(spark, [(f"word {7 * i % 700}", NOW - i) for i in range(900)] + [("rain", NOW - 3 * i) for i in range(300)])
    got = top_k(snapshot_of_events(rows, NOW, 300, 5), 10).collect()
    live = sorted({f"word {7 * i % 700}": 1 for i in range(900) if (NOW - i) // 5 * 5 > NOW - 300})
    rain = sum((NOW - 3 * i) // 5 * 5 > NOW - 300 for i in range(300))
    again = Counter(f"word {7 * i % 700}" for i in range(900) if (NOW - i) // 5 * 5 > NOW - 300)
    first = sorted(live, key=lambda q: (-again[q], q))[:9]
    assert [(r["query"], r["count"]) for r in got] == [("rain", rain), *[(q, again[q]) for q in first]]


def test_top_order_ties_and_zero_counts(spark):
    rows = spark.createDataFrame([("lamp", 0), ("chair", 21), ("desk", 34), ("shelf", 8), ("rug", 2)], "query string, count bigint")
    assert [r["query"] for r in top_k(rows, 9).collect()] == ["desk", "chair", "shelf", "rug", "lamp"]
    assert [r["query"] for r in top_k(rows, 3).collect()] == ["desk", "chair", "shelf"]
    assert top_k(rows.limit(0), 5).collect() == []
    ties = spark.createDataFrame(
        [("ё", 4), ("plum", 4), ("fig", 4), ("Fig", 4), ("pear", 5)], "query string, count bigint"
    )
    assert [r["query"] for r in top_k(ties, 4).collect()] == ["pear", "Fig", "fig", "plum"]
    with pytest.raises(InvalidArgumentError):
        top_k(rows, 0)


def test_trim(spark):
    top = spark.createDataFrame([("oak", 9), ("elm", 7), ("ash", 4), ("yew", 4)], "query string, count bigint")
    for n, want in ((1, 1), (3, 3), (40, 4), (0, 4), (-7, 4)):
        assert [r["query"] for r in trim(top, n).collect()] == ["oak", "elm", "ash", "yew"][:want]


def test_requested_limit():
    assert [requested_limit(x) for x in (None, 1, 100)] == [50, 1, 100]
    for bad in (0, 101, -3):
        with pytest.raises(InvalidArgumentError):
            requested_limit(bad)


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_first_k_per_group_with_and_without_salt(spark, threshold):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    rows = spark.range(900).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 AS string)) AS g", "id % 11 AS v")
    spark.conf.set(name, threshold)
    try:
        got = first_k_per_group(rows, ["g"], [F.desc("v"), F.asc("id")], 5, spread=["id"]).collect()
    finally:
        spark.conf.unset(name)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    want = {(g, i + 1, x[1]) for g, xs in groups.items() for i, x in enumerate(sorted(xs)[:5])}
    assert {(r.g, r["rank"], r.id) for r in got} == want


@pytest.mark.parametrize(("seed", "window", "bucket", "step"), [(1, 20, 5, 5), (2, 20, 5, 1), (3, 9, 3, 2), (4, 10, 5, 7)])
def test_sliding_counts_equal_a_count_per_tick(spark, seed, window, bucket, step):
    rng = random.Random(seed)
    cells = {}
    for _ in range(300):
        key = (rng.randrange(700) // bucket * bucket, f"q{rng.randrange(4)}")
        cells[key] = cells.get(key, 0) + rng.randrange(1, 4)
    rows = spark.createDataFrame(
        [(b, q, n) for (b, q), n in cells.items()], "bucket_start bigint, query string, count bigint"
    )
    want = {}
    for tick in range(0, 700 + 2 * window, step):
        for (b, q), n in cells.items():
            if b <= tick < b + window:
                want[tick, q] = want.get((tick, q), 0) + n
    got = {(r["tick"], r["query"]): r["count"] for r in sliding_counts(rows, window, step).collect()}
    assert got == want
    ranked = tick_top(rows, window, bucket, step, 2).collect()
    by_tick = {}
    for (tick, q), n in want.items():
        by_tick.setdefault(tick, []).append((-n, q))
    expected = {(t, i + 1, q, -n) for t, xs in by_tick.items() for i, (n, q) in enumerate(sorted(xs)[:2])}
    assert {(r["tick"], r["rank"], r["query"], r["count"]) for r in ranked} == expected


def test_drop_totals(spark):
    rows = spark.createDataFrame([("antifraud",), ("stoplist",), ("antifraud",), (None,)], "drop_reason string")
    assert {tuple(r) for r in drop_counts(rows).collect()} == {("antifraud", 2), ("stoplist", 1)}
    assert tuple(drop_rate(rows).first()) == (4, 3, 0.75)
    assert messages_read(rows).first()[0] == 4


def test_time_arithmetic(spark):
    rows = spark.createDataFrame([(0,), (4,), (5,), (1_700_000_003,)], "t bigint")
    got = rows.select(bucket_start(F.col("t"), 5), slot(F.col("t"), 5, 3), rfc3339(F.timestamp_seconds("t"))).collect()
    assert [tuple(r) for r in got] == [
        (0, 0, "1970-01-01T00:00:00Z"),
        (0, 0, "1970-01-01T00:00:04Z"),
        (5, 1, "1970-01-01T00:00:05Z"),
        (1_700_000_000, 340_000_000 % 3, "2023-11-14T22:13:23Z"),
    ]
    fractions = spark.createDataFrame([(1_500_000,), (10_000_010,), (100_000_000,)], "us bigint")
    texts = [r[0] for r in fractions.select(rfc3339(F.timestamp_micros("us"))).collect()]
    assert texts == ["1970-01-01T00:00:01.5Z", "1970-01-01T00:00:10.00001Z", "1970-01-01T00:01:40Z"]


def test_settings_are_checked():
    assert Settings().slots == 60
    for bad in ({"bucket": 0}, {"rate_limit": -1}, {"window": 301}, {"bucket": 0.5}, {"tick": True}):
        with pytest.raises(InvalidArgumentError):
            Settings(**bad)
