import random

import numpy as np
import pandas as pd
import pytest
from models import rate_verdicts
from pyspark.sql import functions as F

from querytide.functions.anchors import NEVER, StretchMap, boundary_maps, composed, handed_down, placed
from querytide.operators import ratelimit
from querytide.operators.ratelimit import rate_windows, with_rate_verdict

@pytest.fixture
def parts_of(spark):
    """Sets the number of partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda parts: spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.shuffle.partitions", before)


COLUMNS = "seq bigint, ip string, arrival bigint"


def verdicts(spark, events, limit, ttl):
    rows = spark.createDataFrame([(seq, ip, arrival) for ip, arrival, seq in events], COLUMNS)
    out = with_rate_verdict(rows, limit, ttl)
    assert out.columns == ["seq", "ip", "arrival", "rate_ok"]
    collected = out.collect()
    assert len(collected) == len(events)
    return {r.seq: r.rate_ok for r in collected}


def test_first_events_pass_then_drop(spark):
    got = verdicts(spark, [("192.168.1.1", 100, i) for i in range(4)], 3, 2)
    assert [got[i] for i in range(4)] == [True, True, True, False]


def test_addresses_do_not_affect_each_other(spark):
    events = [("1.1.1.1", 10, 0), ("2.2.2.2", 10, 1), ("3.3.3.3", 11, 2), ("1.1.1.1", 12, 3)]
    assert verdicts(spark, events, 1, 10) == {0: True, 1: True, 2: True, 3: False}


def test_events_without_address_pass(spark):
    assert set(verdicts(spark, [("", 5, i) for i in range(6)], 1, 10).values()) == {True}


def test_thousand_hits_let_the_limit_through(spark):
    got = verdicts(spark, [("99.99.99.99", 7, i) for i in range(1000)], 500, 5)
    assert [s for s, ok in sorted(got.items()) if ok] == list(range(500))


def test_window_ends_after_ttl_strictly(spark):
    events = [("a", 0, 0), ("a", 1, 1), ("a", 10, 2), ("a", 11, 3), ("a", 12, 4)]
    assert verdicts(spark, events, 1, 10) == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_dropped_events_do_not_extend_the_block(spark):
    events = [("a", t, t) for t in range(0, 40)]
    got = verdicts(spark, events, 2, 9)
    assert [s for s, ok in sorted(got.items()) if ok] == [0, 1, 10, 11, 20, 21, 30, 31]


@pytest.mark.parametrize(("seed", "fan", "parts"), [(1, 2, 7), (2, 2, 2), (3, 3, 12), (4, 64, 5), (5, 2, 1), (6, 2, 9)])
def test_equals_sequential_model(spark, parts_of, monkeypatch, seed, fan, parts):
    monkeypatch.setattr(ratelimit, "FAN", fan)
    parts_of(parts)
    rng = random.Random(seed)
    ttl, limit, span = rng.choice([(3, 2, 80), (10, 4, 400), (7, 1, 200)])
    events = []
    for seq in range(1200):
        # One address holds a third of all events, some arrive in bursts.
        ip = "hot" if rng.random() < 1 / 3 else rng.choice(["", *[f"10.0.0.{i}" for i in range(40)]])
        arrival = rng.randrange(span) if rng.random() < 0.8 else span // 2
        events.append((ip, arrival, seq))
    assert verdicts(spark, events, limit, ttl) == rate_verdicts(events, limit, ttl)


def walked(arrivals, ttl, anchor=None):
    """{arrival: anchor of its window}, one arrival after another."""
    out = {}
    for arrival in arrivals:
        if anchor is None or arrival - anchor > ttl:
            anchor = arrival
        out[arrival] = anchor
    return out


def random_arrivals(rng):
    return sorted({rng.randrange(rng.choice([50, 300, 3000])) for _ in range(rng.randrange(1, 400))})


@pytest.mark.parametrize("seed", range(40))
def test_maps_of_stretches_compose_in_any_grouping(seed):
    rng = random.Random(seed)
    ttl, arrivals = rng.choice([1, 3, 11, 200]), random_arrivals(rng)
    cuts = sorted({0, *(rng.randrange(len(arrivals)) for _ in range(rng.randrange(9)))})
    stretches = [np.array(arrivals[a:b]) for a, b in zip(cuts, [*cuts[1:], len(arrivals)])]
    maps = [StretchMap.of(s, ttl) for s in stretches]
    while len(maps) > 1:
        at = rng.randrange(len(maps) - 1)
        maps[at : at + 2] = [maps[at].then(maps[at + 1], ttl)]
    starts = [NEVER, *range(arrivals[0] - ttl - 2, arrivals[0])]
    want = [walked(arrivals, ttl, None if a == NEVER else a)[arrivals[-1]] for a in starts]
    assert maps[0](np.array(starts), ttl).tolist() == want


@pytest.mark.parametrize("seed", range(40))
def test_scan_over_partitions_equals_walk(seed):
    """All steps on sorted partitions, fed in batches, with a tree of fan 2."""
    rng = random.Random(seed)
    ttl, batch = rng.randrange(1, 30), rng.choice([1, 3, 50, 10_000])
    times = {ip: random_arrivals(rng) for ip in "abc"[: rng.randrange(1, 4)]}
    ticks = pd.DataFrame([(ip, t) for ip, own in times.items() for t in own], columns=["ip", "arrival"])
    ticks["n"], ticks["carried"] = 1, 0
    ticks["part"] = np.sort([rng.randrange(9) for _ in range(len(ticks))])

    def batches(frame):
        return (frame.iloc[i : i + batch].reset_index(drop=True) for i in range(0, len(frame), batch))

    def grouped(frame, step):
        groups = frame.groupby(["ip", frame["node"] // 2])
        return pd.concat([step(key, rows) for key, rows in groups], ignore_index=True)

    parts = [frame for _, frame in ticks.groupby("part")]
    levels = [pd.concat([x for p in parts for x in boundary_maps(ttl)(batches(p))], ignore_index=True)]
    assert len(levels[0]) <= 2 * len(parts)
    while levels[-1]["node"].max() > 1:
        levels.append(grouped(levels[-1], composed(ttl)))
    known = None
    for level in reversed(levels):
        level = level.assign(incoming=NEVER) if known is None else level.assign(node_=level["node"] // 2).merge(
            known.rename(columns={"node": "node_"}), on=["ip", "node_"]
        )
        known = grouped(level, handed_down(ttl))
    incoming = {r.node: r.incoming for r in known.itertuples() if r.incoming != NEVER}
    got = pd.concat([x for p in parts for x in placed(ttl, incoming)(batches(p))])
    for ip, own in times.items():
        mine = got[got["ip"] == ip]
        assert dict(zip(mine["arrival"].tolist(), mine["anchor"].tolist())) == walked(own, ttl)


def test_maps_hold_a_window_at_most():
    for ttl in (1, 9, 1000):
        whole = StretchMap.of(np.arange(20_000), ttl)
        assert len(whole.entries) <= ttl + 2
        halves = StretchMap.of(np.arange(10_000), ttl).then(StretchMap.of(np.arange(10_000, 20_000), ttl), ttl)
        assert halves.entries.tolist() == whole.entries.tolist() and halves.exits.tolist() == whole.exits.tolist()


def test_one_address_with_all_events_is_cut_like_any_rows(spark, monkeypatch):
    """A millisecond clock: no task sees more than its share of the arrivals, and none all maps."""
    monkeypatch.setattr(ratelimit, "FAN", 4)
    events = [("hot", 3 * k + k % 2, k) for k in range(6000)]
    rows = spark.createDataFrame([(seq, ip, arrival) for ip, arrival, seq in events], COLUMNS)
    ticks = ratelimit.tick_counts(rows).repartitionByRange(24, "ip", "arrival").sortWithinPartitions("ip", "arrival")
    ticks = ticks.withColumn("part", F.spark_partition_id()).persist()
    shares = [r["count"] for r in ticks.groupBy("part").count().collect()]
    assert len(shares) == 24 and max(shares) < 4 * 6000 / 24
    levels = []
    keep = ratelimit.stored
    monkeypatch.setattr(ratelimit, "stored", lambda df, name: levels.append(keep(df, name)) or levels[-1])
    got = {r.arrival: r.anchor for r in ratelimit._anchored_by_maps(ticks, 1000).collect()}
    assert got == walked([arrival for _, arrival, _ in events], 1000)
    assert [level.count() for level in levels] == [24, 6, 2]
    ticks.unpersist()


@pytest.mark.parametrize("seed", range(3))
def test_short_ranges_equal_the_scan(spark, seed):
    rng = random.Random(seed)
    ttl, limit, span = rng.choice([(9, 3, 80), (4, 1, 33), (9, 2, 8)])
    rows = {(rng.choice("abcdef"), 1000 + rng.randrange(span)): (rng.randrange(1, 5), rng.choice([0, 0, 2])) for _ in range(90)}
    ticks = spark.createDataFrame(
        [(ip, t, n, carried) for (ip, t), (n, carried) in rows.items()],
        "ip string, arrival bigint, n bigint, carried bigint",
    )
    times = [t for _, t in rows]

    def collected(windows):
        return sorted(map(str, windows.select("ip", "anchor", "n", "cut").collect()))

    scanned = rate_windows(ticks, limit, ttl, collected)
    assert rate_windows(ticks, limit, ttl, collected, (min(times), max(times))) == scanned
    assert rate_windows(ticks, limit, ttl, collected, (min(times), max(times) + 1000 * ttl)) == scanned
