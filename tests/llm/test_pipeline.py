import random

import public_tokenizers
import pytest
from brute import leaks, line_distance, near_duplicates, quality_counts, repeated_lines
from tokenizers import Tokenizer

import corpus_pipeline
from querytide.llm import decontaminate, line_edit_join
from querytide.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


def test_pipeline_equals_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    # The learned rules have no plain version: their verdict is taken from the query, the base rules are not.
    kept = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, TABLES).filter("rule = 0").collect()}
    docs = [(i, t) for i, t in docs if i in kept and not quality_counts(t)[5]]
    lines = repeated_lines(docs, 2, 1, line_distance(line_edit_join.edit_distance))
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines.get(i, ()))) for i, t in docs]
    docs = [d for d, (_, c) in zip(docs, near_duplicates(docs), strict=True) if d[0] == c]
    clean = []
    for (i, t), (words, flags, _) in zip(docs, leaks(docs, items), strict=True):
        if any(flags):
            if sum(flags) >= decontaminate.DROP_SHARE * len(words):
                continue
            edges = [k for k in range(len(words) + 1) if (k < len(words) and flags[k]) != (k > 0 and flags[k - 1])]
            t = decontaminate._cut(t.encode(), edges).decode()
        clean.append((i, t))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in corpus_pipeline.run(spark, TABLES).collect()]
    assert sorted(got) == sorted(want)


def test_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TABLES).columns == docs.columns
        assert stage(spark, docs, TABLES).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).columns == ["doc_id", "ids", "decoded"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, statistics string, row int, place string"


def odd_documents():
    """Null and empty texts, null ids, repeated rows, ties, one very long text, and columns whose names clash."""
    draw = random.Random(4)
    words = [f"{draw.choice('bdkmprst')}{draw.choice('aeiou')}{draw.choice('lnrst')}{k}" for k in range(400)]

    def text(n):
        return "\n".join(" ".join(draw.choice(words) for _ in range(12)) for _ in range(n))

    clean = [text(9) for _ in range(6)]
    texts = [(1, None), (2, ""), (3, "  \n "), (None, clean[0]), (None, None)]
    texts += [(10 + k, t) for k, t in enumerate(clean)]
    texts += [(30, clean[1]), (30, clean[1]), (31, clean[2] + "\none more line"), (32, text(2000))]
    return [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, "y") for i, t in texts]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_of_odd_documents(spark, at):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, ODD)
    name, stage = corpus_pipeline.STAGES[at]
    found = stage(spark, docs, TABLES)
    got = found.collect()
    if name == "BPE encoding":
        assert found.columns == ["doc_id", "ids", "decoded"] and len(got) == len(rows)
        assert all((not r["ids"]) == (r["decoded"] == "") for r in got)
        return
    assert found.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    whole = sorted((i or 0, t or "") for i, t, *_ in rows)
    if name == "quality rules":  # no words: rejected; the rest is clean
        assert kept == [x for x in whole if x[1].strip()]
    if name == "line dedup":  # no row goes; all lines of a later copy do; rows without an id stay as they are
        assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] is None} == {rows[3][1], None}
        assert [r["text"] for r in got if r["doc_id"] == 31] == ["one more line"]
    if name == "near-dedup":  # of copies the smallest id stays
        assert 30 not in [i for i, _ in kept] and 31 not in [i for i, _ in kept] and {11, 12, 32} <= {i for i, _ in kept}
    if name == "benchmark decontamination":
        assert kept == whole
