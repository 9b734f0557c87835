"""Every registered query against its SQL, over the whole tables."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from registered.oracles import ORACLES  # noqa: E402
from registered.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("QUERYTIDE_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    want = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.collect()]
    expected = want.fetchall()
    assert len(rows) == len(expected)
    assert plain(rows, got.columns) == plain(expected, columns)
    assert len(rows) > 0


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 10
