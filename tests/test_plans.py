"""The plans that matter at scale, checked on stored tables."""

import pytest

from querytide.operators.counts import bucket_counts, snapshot_of_events
from querytide.operators.ranking import top_k
from querytide.operators.ratelimit import with_rate_verdict
from querytide.operators.ring import ring_snapshot
from querytide.operators.sliding import tick_top
from querytide.operators.stoplist import normalise, with_stop_verdict
from querytide.sources.stopwords import words_table


@pytest.fixture(scope="module")
def stored_events(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('plans')}/events"
    spark.range(2000).selectExpr(
        "id AS seq",
        "concat('query ', id % 50) AS query",
        "concat('user_', id) AS user_id",
        "if(id % 3 = 0, 'hot', concat('10.0.0.', id % 9)) AS ip",
        "1700000000 + id AS arrival",
        "1700000000 + id AS timestamp",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().toString()



def test_snapshot_reads_two_columns_and_pushes_the_time_filter(stored_events):
    text = plan(snapshot_of_events(stored_events, 1_700_001_999, 300, 5))
    assert "GreaterThan(timestamp,1700001699)" in text
    assert "ReadSchema: struct<query:string,timestamp:bigint>" in text
    assert text.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_bucket_counts_aggregate_before_their_one_shuffle(stored_events):
    physical = plan(bucket_counts(stored_events, 5)).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1 and "partial_count" in physical


def test_top_k_is_a_heap_per_partition(stored_events):
    assert "TakeOrderedAndProject" in plan(top_k(bucket_counts(stored_events, 5), 1000))


def test_ticks_are_cut_before_the_shuffle(stored_events):
    text = plan(tick_top(bucket_counts(stored_events, 5), 300, 5, 1, 1000))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_ring_joins_one_row_per_slot(stored_events):
    text = plan(ring_snapshot(stored_events, 1_700_001_999, 300, 5))
    assert "BroadcastHashJoin" in text and "Window" not in text.split("== Physical Plan ==")[1]


def test_rate_limit_broadcasts_the_blocked_windows(stored_events):
    labelled = with_rate_verdict(stored_events.select("seq", "ip", "arrival"), 2, 10)
    physical = plan(labelled).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
    assert "hashpartitioning" not in physical
    assert labelled.where("NOT rate_ok").count() > 0


def test_short_stop_list_needs_no_join(spark, stored_events):
    words = normalise(words_table(spark, ["query 7", "x"]))
    physical = plan(with_stop_verdict(stored_events, words)).split("== Physical Plan ==")[1]
    assert "Join" not in physical and "Exchange" not in physical


def test_long_stop_list_joins_on_equality(spark, stored_events):
    words = normalise(words_table(spark, ["query 7", "x"]))
    physical = plan(with_stop_verdict(stored_events, words, max_inline=0)).split("== Physical Plan ==")[1]
    assert "NestedLoop" not in physical and "Cartesian" not in physical
