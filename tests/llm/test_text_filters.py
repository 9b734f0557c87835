"""Quality rules, decontamination, personal data."""

import random

from brute import leaks, personal, quality_counts, sha256

from querytide.llm import decision_list, decontaminate, skip_chain

TABLES = "/root/testdata/sf0.001"


def test_counts_and_base_rules(spark):
    choice = random.Random(2)
    texts = [None, "", " \t\n", "a", "a b c a b c", "x " * 60, "A!? #|\nA!? #|\n\nb", "é" * 30_000, "w1 w2 w3 w4 " * 9000]
    texts += ["".join(choice.choice(["a ", "b\n", "c\t", "| ", "Ä\x0b"]) for _ in range(choice.randint(0, 90))) for _ in range(60)]
    docs = spark.createDataFrame([(k % 40 or None, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, quality int")
    got = decision_list.quality(docs, labels).collect()
    want = sorted([(k % 40 or None, *quality_counts(t)) for k, t in enumerate(texts)], key=repr)
    assert sorted([tuple(r)[:7] for r in got], key=repr) == want
    assert all(r["kept"] != r["base_failed"] and r["rule"] == 0 for r in got)  # no labels of both kinds: no rules
    assert decision_list.quality(docs.limit(0), labels).count() == 0


def test_learned_rules_on_held_out_labels(spark):
    choice = random.Random(3)
    rows = []
    for k in range(600):
        words = [choice.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + str(choice.randint(0, 999)) for _ in range(80)]
        bad = k % 5 == 0
        if bad:
            words = [w + "***" for w in words] if k % 2 else [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").drop("quality")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 400], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in decision_list.quality(docs, labels).collect()}
    assert all(got[i] == bool(q) for i, _, q in rows)
    kept = decision_list.accepted(docs.withColumnRenamed("text", "body"), labels, text_col="body")
    assert kept.columns == ["doc_id", "body"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, q in got.items() if q}


def test_quality_runs_no_python(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    plan = docs.select(decision_list.statistics(docs["text"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item"), (2, "b-b"), (3, None), (None, "q q"), (4, "?!")]


def leak_rows():
    ten = "one two three four five six seven eight nine ten"
    texts = [None, "", "?", ten, f"x {ten.upper()} eleven y", "short, item", "bb b-b", "q Q q", ten[4:], f"{ten} " * 3000]
    return [(k or None, t) for k, t in enumerate(texts)] + [(3, "short item short")]


def test_leaks(spark):
    docs = spark.createDataFrame([(*r, 0) for r in leak_rows()], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = []
    for (i, _), (words, flags, ids) in zip(leak_rows(), leaks(leak_rows(), BENCH), strict=True):
        ids = sorted(str(x) for x in ids if x is not None)
        want.append((i, len(words), sum(flags), len(ids), sha256(",".join(ids)), any(flags)))
    for block in (1 << 20, 20):  # one block, and one for nearly every item
        found = decontaminate.find_leaks(docs, bench, block_bytes=block)
        assert sorted(map(tuple, decontaminate.leak_digests(found).collect()), key=repr) == sorted(want, key=repr)
    none = decontaminate.leak_digests(decontaminate.find_leaks(docs, bench.limit(0)))
    assert none.filter("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_are_cut_out(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"a b c d e f g h i j k l, {ten}. z", "keep"), (2, ten, "drop"), (3, None, "keep"), (4, "é clean", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.without_leaks(docs, bench)
    assert got.columns == docs.columns
    want = [(1, "a b c d e f g h i j k l, . z", "keep"), (3, None, "keep"), (4, "é clean", "keep")]
    assert sorted(map(tuple, got.collect())) == want


def test_base_spans_equal_the_patterns():
    choice = random.Random(4)
    texts = ["4532015112830366", "a@b@c.de", "x" * 9 + "@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1" + " " * 2000, "9" * 3000]
    texts += ["".join(choice.choice("1234567890..@@ -+()aB%\n") for _ in range(choice.randint(0, 80))) for _ in range(5000)]
    for text in texts:
        assert skip_chain.base_spans(text) == personal(text)


def test_personal_data_of_a_table(spark):
    again = "call +1 (319) 555-5132 now, I mean 319 555-5132 or é"
    texts = [(k, f"é mail bob.{k}@ex.org, call +1 (319) 555-{1000 + k} from 10.0.0.{k}") for k in range(200)]
    texts += [(None, None), (300, ""), (301, again), (301, again), (302, "1 2 " * 20_000)]
    docs = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, spans int")
    got = skip_chain.span_digests(skip_chain.find_personal_data(docs)).collect()
    assert len(got) == len(texts)
    want = {}
    for i, text in texts:
        spans = personal(text)
        base = ",".join(f"{skip_chain.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want[i] = (*(sum(s[0] == k for s in spans) for k in range(4)), sha256(base))
    for r in got:
        assert tuple(r)[1:6] == want[r["doc_id"]]
    # The number written again without its sign has no base span; the field finds it.
    assert {r["spans"] for r in got if r["doc_id"] == 301} == {"phone:5:22,phone:35:47"}
    assert skip_chain.find_personal_data(docs.limit(0)).count() == 0


def test_the_field_runs_without_base_spans_and_over_many_repeats(spark):
    texts = [(k, f"call +1 (319) 555-{1000 + k} at noon, item {k % 100} of 12 costs 5.{k % 100:02}") for k in range(300)]
    bare = "call 1 (319) 555-7001 at noon, item 7 of 12 costs 5.99"
    often = "call +1 (319) 555-5132 at noon" + " or then 319 555-5132 again" * 150
    texts += [(1000, bare), (1001, often), (1002, "item 7 of 12 costs 5.99")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in skip_chain.find_personal_data(docs).collect() if r["doc_id"] >= 1000}
    assert skip_chain.base_spans(bare) == []
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in got[1000]] == [("phone", 5, 21, False)]
    assert sum(s["kind"] == "phone" and not s["base"] for s in got[1001]) == 150
    assert got[1002] == []


def test_alike_words_are_two_links_apart():
    text = " x ".join(["319 555-5132"] * 40 + ["+1 (319) 555-5132"] + ["319 555-5132"] * 40)
    words = skip_chain.Words(text, skip_chain.base_spans(text))
    (hub,) = [i for i, core in enumerate(words.cores) if core == "555-5132" and words.labels[i]]
    linked = {i for pair in words.skips if hub in pair for i in pair}
    assert linked == {i for i, core in enumerate(words.cores) if core == "555-5132"}
    assert len(words.skips) == len(set(words.skips)) <= 4 * len(words.cores)
