import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querytide.errors import WordsNotFoundError
from querytide.functions.beginnings import BITS, places
from querytide.operators.chain import chain, kept, rate_filter, standard_chain, stop_filter
from querytide.operators.counts import drop_counts
from querytide.operators.stoplist import add_words, delete_words, normalise, texts_with_words, with_stop_verdict
from querytide.plans.trending import reason_counts, top_of_counts, trending
from querytide.settings import DEFAULT_STOP_WORDS, Settings
from querytide.sources.stopwords import (
    add_stop_words,
    create_stop_words,
    current_version,
    default_words,
    delete_stop_words,
    read_stop_words,
    words_table,
)


def words(df):
    return sorted(r.word for r in df.collect())


GOLDEN = [
    ([], "garden hose 20 m", True),
    (["lottery", "casino", "pills"], "paper lanterns for a terrace", True),
    (["lottery", "casino", "pills"], "old casino chips as coasters", False),
    (["LotTery"], "win the LOTTERY tonight", False),
    (["\t pills "], "sleeping pills without a recipe", False),
    (["pill"], "two pillows, blue", False),
    (["трюфель"], "Конфеты ТРЮФЕЛЬНЫЕ, коробка", False),
    (["a.c"], "abc", True),
    (["%"], "50% off", False),
]


@pytest.mark.parametrize(("initial", "query", "passes"), GOLDEN)
@pytest.mark.parametrize("max_inline", [4096, 0])
def test_golden_cases(spark, initial, query, passes, max_inline):
    rows = spark.createDataFrame([(query,), ("",)], "query string")
    listed = normalise(words_table(spark, initial))
    got = with_stop_verdict(rows, listed, max_inline=max_inline).collect()
    assert {r.query: r.stop_ok for r in got} == {query: passes, "": True}


def test_short_and_long_lists_agree_on_long_texts(spark):
    # Occurrences at every position relative to the pieces that the joined way cuts.
    texts = [("x" * n + "Needle" + "y" * 40,) for n in range(230, 280)] + [("x" * 600,), ("ж" * 255 + "иголка",)]
    rows = spark.createDataFrame(texts, "query string")
    listed = normalise(words_table(spark, ["needle", "иголка", "z", "a much longer phrase that never occurs"]))
    inline = {r.query: r.stop_ok for r in with_stop_verdict(rows, listed).collect()}
    joined = {r.query: r.stop_ok for r in with_stop_verdict(rows, listed, max_inline=0).collect()}
    assert inline == joined
    assert sum(not ok for ok in inline.values()) == 51
    assert texts_with_words(rows, listed).count() == 51


def test_words_are_normalised(spark):
    typed = ["  Скам\t", " вейп　", "   ", "", "СКАМ", "курительные смеси"]
    assert words(normalise(words_table(spark, typed))) == ["вейп", "курительные смеси", "скам"]
    assert len(words(default_words(spark))) == len(DEFAULT_STOP_WORDS) == 7
    assert "хакерский софт" in words(default_words(spark))


def test_add_and_delete(spark):
    current = normalise(words_table(spark, ["скам"]))
    current = add_words(current, words_table(spark, ["вейп", "скам", "   ", "ФРОД"]))
    assert words(current) == ["вейп", "скам", "фрод"]
    current = delete_words(current, words_table(spark, ["ВЕЙП", "несуществующее"]))
    assert words(current) == ["скам", "фрод"]
    with pytest.raises(WordsNotFoundError) as caught:
        delete_words(current, words_table(spark, ["казино", "бэттинг"]))
    assert caught.value.code == "WORDS_NOT_FOUND"
    empty = delete_words(current, words_table(spark, ["скам", "фрод"]))
    assert words(empty) == []
    rows = spark.createDataFrame([("скам",)], "query string")
    assert with_stop_verdict(rows, empty).first().stop_ok


def test_versioned_table(spark, folder):
    path = f"{folder}/stop"
    create_stop_words(spark, path, words_table(spark, ["скам"]))
    before = read_stop_words(spark, path)
    add_stop_words(spark, path, words_table(spark, ["вейп", "скам"]))
    assert words(read_stop_words(spark, path)) == ["вейп", "скам"]
    assert words(before) == ["скам"]
    version = current_version(spark, path)
    add_stop_words(spark, path, words_table(spark, [" ВЕЙП ", "  "]))
    assert current_version(spark, path) == version
    with pytest.raises(WordsNotFoundError):
        delete_stop_words(spark, path, words_table(spark, ["казино"]))
    assert current_version(spark, path) == version
    delete_stop_words(spark, path, words_table(spark, ["скам", "вейп"]))
    assert words(read_stop_words(spark, path)) == []
    add_stop_words(spark, path, words_table(spark, ["снова"]))
    assert words(read_stop_words(spark, path)) == ["снова"]


def search(spark, rows):
    """rows: (ip, query), one per second."""
    return spark.createDataFrame(
        [(i, ip, query, i, 1000 + i) for i, (ip, query) in enumerate(rows)],
        "seq bigint, ip string, query string, arrival bigint, timestamp bigint",
    )


def reasons(df):
    return [r.drop_reason for r in df.orderBy("seq").collect()]


def test_rate_limit_comes_before_the_stop_list(spark):
    rows = search(spark, [("a", "скам"), ("a", "ok"), ("a", "скам"), ("b", "ok"), ("", "скам")])
    listed = normalise(words_table(spark, ["скам"]))
    labelled = standard_chain(rows, listed, limit=1, ttl=100)
    # The stop-listed first event uses up the allowance; a row that fails both counts as antifraud.
    assert reasons(labelled) == ["stoplist", "antifraud", "antifraud", None, "stoplist"]
    assert {tuple(r) for r in drop_counts(labelled).collect()} == {("antifraud", 2), ("stoplist", 2)}
    assert [r["query"] for r in kept(labelled).collect()] == ["ok"]


def test_a_filter_sees_only_what_earlier_ones_let_through(spark):
    rows = search(spark, [("a", "скам"), ("a", "ok"), ("a", "ok"), ("b", "ok")])
    listed = normalise(words_table(spark, ["скам"]))
    labelled = chain(rows, [stop_filter(listed), rate_filter(1, 100)])
    assert reasons(labelled) == ["stoplist", None, "antifraud", None]


def test_own_predicates(spark):
    @F.pandas_udf("boolean")
    def short(text: pd.Series) -> pd.Series:
        return text.str.len() <= 3

    rows = search(spark, [("a", "long text"), ("a", "ok"), ("a", None)])
    labelled = chain(rows, [("length", short(F.col("query"))), ("never", F.lit(True))])
    assert reasons(labelled) == ["length", None, "length"]


def test_counted_chain_equals_row_chain(spark):
    rows = search(spark, [(f"ip{i % 3}", ["скам ok", "ok", "go"][i % 4 % 3]) for i in range(60)])
    listed = normalise(words_table(spark, ["скам"]))
    settings = Settings(rate_limit=4, rate_ttl=30, bucket=5, window=300)
    labelled = chain(rows, [rate_filter(4, 30, first=True)])
    counted = reason_counts(labelled, listed, 5)
    want = drop_counts(standard_chain(rows, listed, 4, 30)).collect()
    assert sorted(drop_counts(counted, F.col("count")).collect()) == sorted(want)
    kept_counts = counted.where("drop_reason IS NULL")
    by_event = trending(rows, listed, settings, 1060).collect()
    assert by_event == top_of_counts(kept_counts, settings, 1060).collect()
    assert len(by_event) == 2


def test_a_beginning_that_is_the_whole_word_is_looked_up_once(spark):
    numbers = [-1] * (BITS // 64)  # every bit
    text = "añb" * 5000
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["key", "text"])
    once = [r for b in places(2, True, numbers, ["key", "at", "word"])([batch]) for r in b.to_pylist()]
    assert sorted((r["at"], r["word"]) for r in once) == [(1, "añ"), (2, "ñb"), (3, "ba")]
    every = [r for b in places(3, False, numbers, ["key", "at", "word"])([batch]) for r in b.to_pylist()]
    assert [(r["at"], r["word"]) for r in every] == [(k + 1, text[k : k + 3]) for k in range(len(text) - 2)]
