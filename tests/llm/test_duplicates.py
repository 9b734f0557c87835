"""Lines, passages, near-duplicates."""

import random

import pyarrow as pa
import pytest
from brute import covered_words, edits, near_duplicates, repeated_lines, sha256

from querytide.llm import circulant_minhash, line_edit_join, relative_lempel_ziv
from querytide.llm.components import components


def test_edit_distance():
    choice = random.Random(1)
    for _ in range(5000):
        a = "".join(choice.choice("ab") for _ in range(choice.randint(0, 14)))
        b = "".join(choice.choice("abc") if choice.random() < 0.2 else c for c in a if choice.random() > 0.1)
        for limit in range(4):
            assert line_edit_join.edit_distance(a, b, limit) == min(edits(a, b), limit + 1)


def line_rows():
    choice, rows = random.Random(5), []
    for k in range(50):
        lines = []
        for _ in range(choice.randint(0, 5)):
            line = list(f"the quick brown fox jumps over {choice.randint(1, 30)} lazy dogs é")
            for _ in range(choice.randint(0, 3)):
                at, kind = choice.randrange(len(line)), choice.random()
                if kind < 0.3:
                    del line[at]
                else:
                    line[at : at + (kind < 0.6)] = choice.choice("xyzé ")
            lines.append("".join(line) + choice.choice(["", " ", "\r"]))
        rows.append((k, "\n".join(lines)))
    same = "the quick brown fox jumps over 1 lazy dogs é"
    return rows + [(None, same), (500, None), (501, ""), (502, "\n".join([same] * 3)), (503, "z" * 50_000), (504, "y" * 900), (505, "y" * 901)]


@pytest.mark.parametrize(("hot", "block", "sent"), [(16, 256, 500_000), (500, 256, 500_000), (2, 4, 0)])
def test_lines(spark, monkeypatch, hot, block, sent):
    monkeypatch.setattr(line_edit_join, "HOT", hot)
    monkeypatch.setattr(line_edit_join, "BLOCK", block)
    monkeypatch.setattr(line_edit_join, "MAX_SENT", sent)
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, line int")
    found = repeated_lines(rows, line_edit_join.DISTANCE, line_edit_join.MIN_CHARS)
    want = [(i, len(t.split("\n")) if t is not None else 0, len(found.get(i, ())), ",".join(map(str, found.get(i, ())))) for i, t in rows]
    assert sorted(map(tuple, line_edit_join.line_report(docs).collect()), key=repr) == sorted(want, key=repr)
    cut = line_edit_join.without_repeated_lines(docs)
    assert cut.columns == docs.columns
    texts = [(i, t if not found.get(i) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in found[i]), 0) for i, t in rows]
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(texts, key=repr)


def test_keys_of_lines(monkeypatch):
    choice = random.Random(8)
    lines = ["".join(choice.choice("etaé日 ") for _ in range(choice.randint(2, 400))) for _ in range(200)] + ["é" * 700, "e" * 300]
    column, made = pa.array(["left out", *lines]).slice(1), {}
    for size in (line_edit_join.GROUP_BYTES, 500, 1):
        monkeypatch.setattr(line_edit_join, "GROUP_BYTES", size)
        for own in (True, False):
            counts, bags, keys = (x.tolist() for x in line_edit_join.Keys(2, 24, own)(column))
            assert made.setdefault(own, (counts, bags, keys)) == (counts, bags, keys)
            places = [[p for p in line_edit_join._places(len(x), 2, 24) if p[3] == own] for x in lines]
            assert counts == list(map(len, places))
            assert bags == [sum(x.count(c) % 16 << 4 * k for k, c in enumerate(line_edit_join.COUNTED)) for x in lines]
            cut = [(x[a:b], seed) for x, found in zip(lines, places, strict=True) for a, b, seed, _ in found]
            assert len(set(zip(cut, keys, strict=True))) == len(set(cut)) == len(set(keys))
    empty = line_edit_join.Keys(2, 24, True)(pa.array([], pa.string()))
    assert [len(x) for x in empty] == [0, 0, 0]


def test_own_keys_are_not_looked_up_again(spark):
    lines = spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs")], "id long, line string")
    own, other = ({r["key"] for r in line_edit_join._keyed(lines, 2, 24, alone).collect()} for alone in (True, False))
    assert len(own) == 3 and len(other) == 9 and not own & other


def short_rows():
    choice, rows = random.Random(11), [(0, "Home\nShare\n\n \nShare\nHome \nHone"), (1, "Home\nAll rights reserved.\nx"), (2, "All rights reserved\nx\r\n")]
    for k in range(3, 60):
        lines = []
        for _ in range(8):
            line = list("read more of this story now"[: choice.randint(1, 27)])
            for _ in range(choice.randint(0, 2)):
                line.insert(choice.randrange(len(line) + 1), choice.choice("xyz")) if choice.random() < 0.5 else line.pop()
                line = line or ["r"]
            lines.append("".join(line))
        rows.append((k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("hot", "block", "sent"), [(500, 256, 500_000), (2, 4, 0)])
def test_short_lines(spark, monkeypatch, hot, block, sent):
    for name, value in (("HOT", hot), ("BLOCK", block), ("MAX_SENT", sent)):
        monkeypatch.setattr(line_edit_join, name, value)
    rows = short_rows()

    def measure(a, b, limit):  # two edits from 24 code points of the shorter line, one from 12, else none
        far = edits(a, b)
        return far if far <= min(2, min(len(a), len(b)) // 12) else limit + 1

    want = repeated_lines(rows, 2, 1, measure)
    assert want[0] == [4, 5] and want[1] == [0] and want[2] == [0, 1]  # "Hone" is another line than "Home"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_edit_join.line_report(docs).collect()}
    assert got == {i: ",".join(map(str, want.get(i, ()))) for i, _ in rows}


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_edit_join.line_report(docs).count() == 0


def passage_rows():
    choice = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    passages = [[choice.choice(words) for _ in range(n)] for n in (49, 50, 51, 60, 120, 300)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(choice.randint(0, 4)):
            own = [choice.choice(words) for _ in range(choice.randint(0, 70))]
            part = list(choice.choice(passages))
            if choice.random() < 0.4:
                part[choice.randrange(len(part))] = "changed"
            text += own + part
        rows.append((k, choice.choice([" ", "\n", " \t"]).join(text)))
    loop = " ".join(["a b"] * 200)
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (300, loop), (301, loop + " c"), (302, None), (303, " "), (304, "x " * 30_000)]


def test_passages(spark):
    rows = passage_rows()
    docs = spark.createDataFrame([(*r, 0) for r in rows + [(None, rows[3][1])]], "doc_id long, text string, kept int")
    factored = relative_lempel_ziv.factor(docs)
    got = {r["doc_id"]: r for r in factored.collect()}
    digests = {r["doc_id"]: tuple(r)[1:] for r in relative_lempel_ziv.kept_digests(factored).collect()}
    want = covered_words(rows)
    texts = {i: words for i, (words, _) in want.items()}
    for i, (words, flags) in want.items():
        kept = " ".join(w for w, f in zip(words, flags, strict=True) if not f)
        assert digests[i] == (len(words), sum(flags), sha256(kept)), i
        at = 0
        for f in got[i]["factors"]:  # each factor is whole in its source, and the factors reach as far as the spans
            part, source = words[f["start"] : f["start"] + f["words"]], texts[f["source"]]
            assert f["source"] < i and f["start"] >= at and len(part) >= 50
            assert all(flags[f["start"] : f["start"] + f["words"]])
            assert any(source[k : k + 50] == part[:50] for k in range(len(source) - 49))
            at = f["start"]
        assert bool(got[i]["factors"]) == any(flags)
    assert digests[None] == (len(texts[3]), 0, sha256(" ".join(texts[3])))
    assert relative_lempel_ziv.factor(docs.limit(0)).count() == 0


def near_rows():
    choice = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows, k = [], 0
    for n in (3, 5, 8, 40, 80, 150):
        base = [choice.choice(words) for _ in range(n)]
        for _ in range(25):
            text = list(base)
            for _ in range(choice.randint(0, max(1, n // 18))):
                text[choice.randrange(n)] = choice.choice(words)
            rows.append((k, choice.choice([" ", "\n "]).join(text).upper() if k % 3 else " ".join(text)))
            k += 1
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, "a b"), (None, "lone words"), (904, "v " * 20_000)]


def test_near_duplicates(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    got = sorted(map(tuple, circulant_minhash.near_duplicates(docs).collect()), key=repr)
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, near_duplicates(rows), strict=True)]
    assert got == sorted(want, key=repr)
    stay = circulant_minhash.one_of_each(docs)
    assert stay.columns == docs.columns
    kept = sorted([(*r, 0) for r, w in zip(rows, want, strict=True) if w[3]], key=repr)
    assert sorted(map(tuple, stay.collect()), key=repr) == kept
    assert circulant_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_group_of_changed_copies_is_not_expanded_into_its_pairs(spark, monkeypatch):
    choice, rows = random.Random(9), []
    base = [f"w{k}" for k in range(150)]
    for k in range(240):  # from four changes on, copies are no longer linked with the others; some share a change
        text = list(base)
        for place in choice.sample(range(5, 145), k % 8):
            text[place] = f"new{k}" if choice.random() < 0.9 else f"new{k % 60}"
        rows.append((k, " ".join(text)))
    compared, verified = [], circulant_minhash._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(circulant_minhash, "_verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, circulant_minhash.near_duplicates(docs).collect()))
    assert got == [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, near_duplicates(rows), strict=True)]
    assert sum(r[3] for r in got) > 60
    assert compared[2] < 5 * len(rows)  # the rest, after one hub and all hubs of each node


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_texts_that_meet_no_other_are_not_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(circulant_minhash, "MAX_SENT", sent)
    plans, sets = [], circulant_minhash._sets
    monkeypatch.setattr(circulant_minhash, "_sets", lambda docs: plans.append(docs) or sets(docs))
    rows = [(k, f"{k} " * 9 + "a b c d e f g") for k in range(30)] + [(40, "l m n o p q r s"), (41, "l m n o p q r s"), (42, "l m n o p q r s t")]
    got = circulant_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == sorted((k, k not in (41, 42)) for k, _ in rows)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert ("LeftSemi, BuildRight" in plan) == (sent > 0)


def test_components(spark):
    choice = random.Random(8)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(choice.randint(200, 260), choice.randint(200, 260)) for _ in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
