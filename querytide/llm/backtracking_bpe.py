"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token that starts at each place of a word. The encoder
walks from left to right, takes the longest match that may stand beside the token before it, falls back to shorter
matches, and steps back where none fits. Whether two tokens may stand side by side is a matter of the merge order
alone and is kept in a pair table, so each place is visited a bounded number of times and the result equals the one
that applies the merges in order.

The tokenizer file is read on the driver (its size is checked) and broadcast. Text is cut into pieces as the file's
normalizer and splitter do; the merging and the decoding are done here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.errors import QuerytideError
from querytide.llm.common import Cache, give_back, lists
from querytide.llm.pieces import PieceEncoder, forget, kept, read_vocabulary

_PAIRS_KEPT = 400_000
#: Words kept by a worker: fewer than in op8, as the pair table and the automaton stand beside them.
_WORDS_KEPT = 400_000


class BacktrackingBpe:
    """Exact merges for byte-level BPE with word ends, as the tokenizers library applies them."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges")):
            raise QuerytideError("only plain BPE models can be encoded")
        vocabulary = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}

        # Symbols are single characters; the last of a word is shifted into a range of its own.
        self.shift = 0x10000 if self.end else 0
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        if len(made) != len(merges):
            raise QuerytideError("a token has two merges")
        order = [t for t in vocabulary if t not in made] + [a + b for a, b in merges]
        rank = {t: i for i, t in enumerate(order)}
        self.ids = [vocabulary[t] for t in order]
        symbols = [self._symbols(t) for t in order]
        self.length = [len(s) for s in symbols]
        self.parts = [(i, i) for i in range(len(order))]
        self.joined = {}
        for left, right in merges:
            a, b, c = rank[left], rank[right], rank[left + right]
            self.parts[c] = (a, b)
            self.joined[a, b] = c
        self.automaton = ahocorasick.Automaton()
        known = {}
        for i, s in enumerate(symbols):
            self.automaton.add_word(s, i)
            known[s] = i
        self.automaton.make_automaton()
        self.shorter = [
            next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), -1) for s in symbols
        ]
        self.pairs = Cache(lambda pair: self._may_touch(*pair), _PAIRS_KEPT)
        encoder = PieceEncoder(source, self.ids_of_piece, _WORDS_KEPT)
        self.encode, self.encode_all = encoder.encode, encoder.encode_all

        # The offset table: token i is blob[offsets[i]:offsets[i + 1]], each with the blank that decoding puts between.
        texts = {i: t for t, i in vocabulary.items()} | {i: t for t, i in added.items()}
        pieces = [(texts.get(i, "") + " ").encode() if i in texts else b"" for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + self.shift)
        return token

    def _may_touch(self, left: int, right: int) -> bool:
        """Whether merging `left right` in order leaves them apart: undo merges on both sides of the seam, latest
        first, and see whether an earlier merge would have joined what then touches."""
        limit = len(self.ids)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, self.parts[left][1]
                if left == limit:
                    return True

    def ids_of_piece(self, piece: str) -> list[int]:
        """The ids of one piece, given in byte characters. Tokens that may touch pairwise and fill the piece are the only
        such row, so any way that finds one gives the same ids."""
        word = piece[:-1] + chr(ord(piece[-1]) + self.shift)
        found = self._walked(word)
        return [self.ids[t] for t in (self._backtrack(word) if found is None else found)]

    def _walked(self, word: str) -> list[int] | None:
        """The tokens of a word by backtracking, with longest matches looked up only at the places that are visited; None
        if there is no match at one of them or no way through."""
        n, length, shorter, pairs, longest = len(word), self.length, self.shorter, self.pairs, self.automaton.iter_long
        found: list[int] = []
        shut: set[int] = set()
        place, before, matches = 0, -1, longest(word)
        while True:
            last, token = next(matches, (-1, -1))
            if token < 0 or last + 1 - length[token] != place:
                return None
            while True:
                while token >= 0:
                    stop = place + length[token]
                    if (before < 0 or pairs[before, token]) and stop not in shut:
                        break
                    token, matches = shorter[token], None
                if token >= 0:
                    break
                if not found:
                    return None
                shut.add(place)
                token, matches = found.pop(), None
                place, before = place - length[token], found[-1] if found else -1
            found.append(token)
            place, before = stop, token
            if place == n:
                return found
            matches = matches or longest(word, place)

    def _backtrack(self, word: str) -> list[int]:
        n, length, shorter, pairs = len(word), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for last, token in self.automaton.iter(word):  # by their ends, so the longest comes last
            longest[last + 1 - length[token]] = token
        open_ends = bytearray(b"\1") * (n + 1)
        found: list[int] = []
        place, token, before = 0, longest[0], -1
        while place < n:
            while token >= 0:
                stop = place + length[token]
                if open_ends[stop] and (before < 0 or pairs[before, token]):
                    break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                place, before = stop, token
                token = longest[place] if place < n else -1
            elif found:
                open_ends[place] = 0
                token = found.pop()
                before = found[-1] if found else -1
                place -= length[token]
            else:
                raise QuerytideError("a symbol of the text is not in the vocabulary")
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of the ids, joined by blanks."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        places = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[places].tobytes()[:-1]


def encode_and_decode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, ids (array of int) and decoded (string), one row per row of `docs`, other columns left out. A null
    text is empty: no ids and an empty decoded text. Rows with a null or repeated id are kept as they are; an empty table
    gives none. The bytes of a text are those Spark holds; broken UTF-8 counts as U+FFFD.
    """
    source = docs.sparkSession.sparkContext.broadcast({"source": read_vocabulary(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An idle worker would keep the encoder and all its tables, about 200 MB, for a minute.
        try:
            yield from _encoded(kept(source.value, BacktrackingBpe), batches)
        finally:
            forget(source.value)

    def _encoded(bpe: BacktrackingBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for ids, counts in bpe.encode_all(batch.column(1)):
                texts = [bpe.decode(found).decode() for found in np.split(ids, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        lists(ids.view(np.int32), counts, pa.int32()),
                        pa.array(texts, pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )
                first += len(counts)
            give_back()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode_and_decode()'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
