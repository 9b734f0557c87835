import gc
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import sha256
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querytide.llm import pieces
from querytide.llm.backtracking_bpe import BacktrackingBpe, digests, encode_and_decode
from querytide.llm.pieces import PieceEncoder, read_vocabulary
from querytide.llm.token_files import read_token_files, with_crc32, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SOURCE = read_vocabulary(PATH)
BPE, PIECES = BacktrackingBpe(SOURCE), PieceEncoder(SOURCE)
ODD = ["", " \n", "a" * 3000, "<|endoftext|>x<|startoftext|> <|endoftext|", "don't'VE I'M", "é Σςİ", "a\x1cb\x00c d"]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(text):
    ids = library(text)
    assert BPE.encode(text.encode()).tolist() == ids
    assert PIECES.encode(text.encode()).tolist() == ids
    assert BPE.decode(np.array(ids, np.uint32)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    check(text)


@pytest.mark.parametrize("alphabet", ["ethionrsa ", "the'slvrmd 0.,!\n", "".join(map(chr, range(0x250))), "日本語ひらがな한국어 a"])
def test_random_text_equals_the_library(alphabet):
    choice = random.Random(alphabet)
    for _ in range(400):
        check("".join(choice.choice(alphabet) for _ in range(choice.randint(0, 80))))


@pytest.mark.parametrize("text", ODD)
def test_odd_text_equals_the_library(text):
    check(text)


@pytest.mark.parametrize("size", [1, 40, 4 << 20])
def test_groups_of_texts_equal_the_library(monkeypatch, size):
    monkeypatch.setattr(pieces, "GROUP_BYTES", size)
    choice = random.Random(size)
    texts = [*ODD, None, *(" ".join(choice.choice(["The", "the,", "日本", "x<|endoftext|>", "é\x1c", "a" * 70]) for _ in range(9)) for _ in range(20))]
    for encoder in (BPE, PIECES):
        for column in (pa.array(["left out", *texts]).slice(1), pa.array(texts, pa.large_string())):
            found = list(encoder.encode_all(column))
            assert np.concatenate([ids for ids, _ in found]).tolist() == [i for t in texts for i in library(t)]
            assert np.concatenate([counts for _, counts in found]).tolist() == [len(library(t)) for t in texts]
    assert list(PIECES.encode_all(pa.array([], pa.string()))) == []
    assert PIECES.encode(b"a\xff b").tolist() == library("a\ufffd b")


def test_a_piece_of_many_words_is_encoded_once():
    asked = []
    encoder = PieceEncoder(SOURCE, lambda piece: asked.append(piece) or PIECES.one(piece))
    text = "The the, THE. (the) the the! other " * 50
    assert encoder.encode(text.encode()).tolist() == library(text)
    assert len(asked) == len(set(asked))


def test_pieces_are_forgotten_when_too_many_are_known():
    encoder = PieceEncoder(SOURCE, size=3)
    for text in ("a b c d", "b e", "a b"):
        assert encoder.encode(text.encode()).tolist() == library(text)
    assert sorted(encoder.numbers.known) == ["", "a", "b", "e"]


def rows():
    return [(k, t) for k, t in enumerate(ODD)] + [(2, "twice"), (2, "Twice"), (None, "no id"), (99, None), (50, "word " * 20_000)]


def test_encoding_of_a_table(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows()], "doc_id long, text string, ids string, decoded string")
    got = sorted(map(tuple, digests(encode_and_decode(docs, PATH)).collect()), key=repr)
    want = []
    for i, t in rows():
        ids = library(t)
        want.append((i, len(ids), sha256(" ".join(map(str, ids))), sha256(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert encode_and_decode(docs.limit(0), PATH).count() == 0


def test_an_idle_worker_holds_no_encoder(spark):
    def broadcast(held):
        return SimpleNamespace(value=docs.held.append(held) or held)

    docs = SimpleNamespace(held=[], sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=broadcast)))
    docs.select = lambda *columns: docs
    docs.mapInArrow = lambda run, schema: run
    run = encode_and_decode(docs, PATH)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    for _ in range(2):
        assert [b.column(1).to_pylist() for b in run(iter([batch]))] == [[library("a b"), []]]
        assert list(docs.held[0]) == ["source"]
        assert [x for x in gc.get_objects() if isinstance(x, BacktrackingBpe)] == [BPE]


def test_token_files(spark, folder):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, tokens int")
    write_token_files(docs, PATH, f"{folder}/t", end_id=1, files=3)
    read = read_token_files(spark, f"{folder}/t")
    got = [tuple(r) for r in with_crc32(read).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library(t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = read.filter("doc_id = 50").first()
    assert one["tokens"] == [*library("word " * 20_000), 1]


def test_token_files_read_the_narrow_columns_alone(spark, folder):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    write_token_files(docs, PATH, f"{folder}/t", end_id=1)
    plan = read_token_files(spark, f"{folder}/t", tokens=False)._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("Physical Plan")[1]


def test_token_files_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, PATH, f"{folder}/t", end_id=1)
    assert with_crc32(read_token_files(spark, f"{folder}/t")).count() == 0
