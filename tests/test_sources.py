import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from querytide.schema import MESSAGE
from querytide.sources import messages as M
from querytide.sources.published import (
    SLOTS,
    envelope_json,
    latest,
    published_json,
    published_top,
    publish,
    top_queries,
)
from querytide.sources.slots import SlottedTable
from querytide.schema import TOP

GOOD = '{"user_id":"reader-17","query":"Детские Книги о море","ip":"198.51.100.23","timestamp":1700000123}'
FULL = ("Детские Книги о море", "reader-17", "198.51.100.23", 1700000123)

# payload, event or None, event in strict mode or None
CASES = [
    (GOOD, FULL, FULL),
    (" " + GOOD + "\n", FULL, FULL),
    ('{"query":"a","page":7}', ("a", "", "", 0), ("a", "", "", 0)),
    ('{"query":null,"timestamp":null}', ("", "", "", 0), ("", "", "", 0)),
    ("{}", ("", "", "", 0), ("", "", "", 0)),
    ("", None, None),
    (None, None, None),
    ("not json", None, None),
    ("null", None, None),
    ('{"query":"a"', None, None),
    ('{"query":"a","timestamp":1.5}', None, None),
    ('{"query":"a","timestamp":"7"}', None, None),
    ('{"query":"a","timestamp":99999999999999999999}', None, None),
    ('{"query":"a","timestamp":-1}', None, None),
    ('{"query":5}', ("5", "", "", 0), None),
    ('{"query":{"a":1}}', ('{"a":1}', "", "", 0), None),
    ('{"query":"a"} trailing', None, None),
    ('[{"query":"a"}]', None, None),
    ('"text"', None, None),
    ('{"query":"a","query":"b"}', ("b", "", "", 0), None),
]


@pytest.mark.parametrize("strict", [False, True])
def test_decoding(spark, strict):
    rows = spark.createDataFrame(
        [(i, None if payload is None else payload.encode()) for i, (payload, *_) in enumerate(CASES)],
        "seq bigint, value binary",
    )
    got = {r.seq: (r.query, r.user_id, r.ip, r.timestamp) for r in M.decode(rows, strict).collect()}
    want = {i: case[2 if strict else 1] for i, case in enumerate(CASES)}
    assert got == {i: event for i, event in want.items() if event}
    bad = M.quarantine(rows, strict).collect()
    assert {r.seq for r in bad} == {i for i, event in want.items() if not event}
    assert all(r.bad_reason for r in bad)


def test_encoding_is_undone_by_decoding(spark):
    rows = spark.createDataFrame([FULL, ('quote " and \\ and ё', "", "", 0)], "query string, user_id string, ip string, timestamp bigint")
    encoded = M.encode(rows)
    assert [r.key for r in encoded.collect()] == ["198.51.100.23", ""]
    assert json.loads(encoded.first().value) == json.loads(GOOD)
    assert sorted(M.decode(encoded).collect()) == sorted(rows.collect())


def test_kafka_options_and_missing_connector(spark):
    options = M.kafka_options(["a:9092", "b:9092"], "searches", group="trends", max_offsets=1000)
    assert options == {
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "searches",
        "kafka.fetch.max.bytes": "10000000",
        "kafka.group.id": "trends",
        "maxOffsetsPerTrigger": "1000",
    }
    with pytest.raises(PySparkException):
        M.read_kafka(spark, brokers=["a:9092"], topic="searches")


def test_message_files(spark, folder):
    rows = spark.createDataFrame([(b"ip", GOOD.encode(), 0, 1, None)], MESSAGE)
    rows.write.parquet(f"{folder}/messages")
    assert M.decode(M.read_message_files(spark, f"{folder}/messages", streaming=False)).first().query == FULL[0]
    stream = M.read_message_files(spark, f"{folder}/messages", files_per_trigger=1)
    assert stream.isStreaming and stream.columns == MESSAGE.names


def test_top_list_before_the_first_snapshot(spark, folder):
    assert published_top(spark, f"{folder}/none").collect() == []
    assert published_top(spark, f"{folder}/none").schema == TOP
    row = latest(spark, f"{folder}/none").first()
    assert row.data == [] and row.updated_at is not None


def test_published_list_is_the_newest(spark, folder):
    path, when = f"{folder}/top", F.timestamp_seconds(F.lit(1_700_000_000))
    for i in range(SLOTS + 3):
        top = spark.createDataFrame([("a", i), ("b", i), ("c", 100)], TOP)
        publish(top, path, i, when)
    got = [tuple(r) for r in published_top(spark, path).collect()]
    assert got == [("c", 100), ("a", SLOTS + 2), ("b", SLOTS + 2)]
    assert [r["query"] for r in published_top(spark, path, 1).collect()] == ["c"]
    assert top_queries(spark, path).count() == 3
    with pytest.raises(ValueError):
        top_queries(spark, path, 101)
    body = published_json(spark, path).first().body
    assert body.startswith('{"data":[{"query":"c","count":100},') and body.endswith('"updated_at":"2023-11-14T22:13:20Z"}')


def test_envelope(spark):
    when = F.timestamp_seconds(F.lit(1_700_000_000))
    top = spark.createDataFrame([("осенний лес", 10)], TOP)
    want = '{"data":[{"query":"осенний лес","count":10}],"updated_at":"2023-11-14T22:13:20Z"}'
    assert envelope_json(top, when).first().body == want
    assert envelope_json(top.limit(0), when).first().body == '{"data":[],"updated_at":"2023-11-14T22:13:20Z"}'


def test_slotted_table(spark, folder):
    table = SlottedTable(f"{folder}/slots", TOP)
    assert table.read(spark, -1).count() == 0
    for batch in range(6):
        before = table.read(spark, batch - 1)
        table.write(before.unionByName(spark.createDataFrame([("q", batch)], TOP)), batch)
    table.write(table.read(spark, 4).unionByName(spark.createDataFrame([("q", 5)], TOP)), 5)
    assert sorted(r["count"] for r in table.read(spark, 5).collect()) == list(range(6))
