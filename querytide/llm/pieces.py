"""Cutting text into the pieces a tokenizer file encodes one by one, so that ids of known pieces are looked up."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from querytide.errors import QuerytideError
from querytide.llm.common import Cache, as_bytes, give_back

#: A tokenizer file beyond this is refused: it is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Words, or pieces of words, kept by a Python worker, and the longest one kept.
KEPT, LONGEST_KEPT = 400_000, 64
#: Bytes of text that are encoded together; a longer text is encoded by itself.
GROUP_BYTES = 2 << 20

# The normalizer and the splitter of word BPE files, for which the quick cut below holds.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The quick cut: over these characters composing changes nothing, each has one lower-case form, and their kinds are
# plain (blank, digit, letter, other). Everything else goes through the library's normalizer and splitter.
_QUICK = re.compile(r"[!-~¡-©«-±´¶-¸»¿-įı-ſ]+")
_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ſ]+|[0-9]|[^0-9a-zß-öø-ſ]+")


def read_vocabulary(path: str) -> str:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise QuerytideError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in sorted(plain)} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts one after another, and how many each part has."""
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)


def _spread(ids: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chosen parts one after another, and how many each has; `counts` are those of all parts."""
    starts, counts = (np.cumsum(counts) - counts)[chosen], counts[chosen]
    ends = np.cumsum(counts)
    places = np.repeat(starts - (ends - counts), counts)
    places += np.arange(len(places))
    return ids[places], counts


def _sums(counts: np.ndarray, cells: pa.ListArray) -> np.ndarray:
    """The sum of the counts of each list's values."""
    lengths = np.asarray(cells.value_lengths().fill_null(0))
    before = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(lengths)
    return before[ends] - before[ends - lengths]


def _numbered(cells: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a list column, and the number of each value in turn."""
    found = cells.flatten().dictionary_encode()
    return found.dictionary, np.asarray(found.indices)


def _strings(values: pa.Array) -> list[str]:
    """to_pylist() of strings without line feeds, several times as fast."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n") if len(values) else []


class _Numbers:
    """Numbers of pieces, with the ids of each in one array. It starts over when `size` pieces are known."""

    def __init__(self, many: Callable[[list[str]], list[list[int]]], size: int) -> None:
        self.many, self.size = many, size
        self._start_over()

    def _start_over(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces."""
        if len(self.known) > self.size:
            self._start_over()
        known, first = self.known, len(self.known)
        new = [p for p in pieces if p not in known]
        if new:
            found = self.many(new)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, counts.sum())
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


class PieceEncoder:
    """Encodes whole texts piece by piece. `one(piece)` gives the ids of one piece, written in byte characters; `size`
    words are kept."""

    def __init__(self, source: str, one: Callable[[str], list[int]] | None = None, size: int = KEPT) -> None:
        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.table = self.library.model, byte_characters()
        self.one = one or self._by_model
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile("|".join(marks)) if marks else None
        self.quick = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLITTER
        # A piece by itself is a word that is cut into that piece alone, unless it is the string of an added token.
        self.pieces_are_words = not any(_CUT.fullmatch(t.lower()) for t in self.added)
        self.words = Cache(self._ids, size)
        self.numbers = _Numbers(self._pieces, size)

    def _by_model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII characters stand for themselves.
        characters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return _packed(self.one(characters))

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of plain pieces, which have no line feeds."""
        characters = "\n".join(pieces).encode().decode("latin-1").translate(self.table | {10: "\n"}).split("\n")
        return [self.one(c) if c else [] for c in characters]

    def _slow(self, text: str) -> bytes:
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([_packed(self.one(p)) for p, _ in cut if p])

    def _plain(self, text: str) -> bytes:
        if not self.quick or not _QUICK.fullmatch(text):
            return self._slow(text)
        return b"".join([self._piece(p) for p in _CUT.findall(text.lower())])

    def _ids(self, text: bytes) -> bytes:
        if self.quick and self.pieces_are_words and text.isalpha():  # one piece of plain letters
            return self._piece(text.lower().decode())
        text = text.decode("utf-8", "replace")
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), _packed([self.added[m.group()]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a whole text; the strings of added tokens in it are those tokens."""
        return next(self.encode_all(pa.array([text])))[0]

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts one after another, and how many each text has, for a group of texts at a time; null is
        empty. Words are told apart and cut by Arrow, and each distinct piece of a group is looked up once."""
        texts = texts.cast(pa.large_binary())
        sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(texts):
            before = ends[first] - sizes[first]
            end = max(first + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
            yield self._group(texts.slice(first, end - first))
            first = end

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.quick or not self.pieces_are_words:
            return _laid_out([np.frombuffer(self._ids(text), np.uint32) for text in as_bytes(texts)])
        # Not checked as UTF-8: blanks are found byte by byte, and words with broken bytes are not plain below.
        cells = pc.ascii_split_whitespace(texts.cast(pa.binary()).view(pa.string()))  # blanks part pieces and leave none
        words, numbers = _numbered(cells)
        ids, counts = _spread(*self._of_words(words), numbers)
        return ids, _sums(counts, cells)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words: plain ones by their pieces, the others one by one."""
        plain = pc.and_(
            pc.match_substring_regex(words, f"^(?:{_QUICK.pattern})$"), pc.less_equal(pc.binary_length(words), LONGEST_KEPT)
        )
        for mark in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, mark))
        cells = pc.ascii_split_whitespace(
            pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _CUT.pattern, r"\0 ")
        )
        pieces, places = _numbered(cells)
        numbers = self.numbers(_strings(pieces))
        ids, counts = _spread(self.numbers.ids, self.numbers.counts, numbers[places])
        plain = np.asarray(plain)
        if plain.all():
            return ids, _sums(counts, cells)
        others = words.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
        found = [self.words[w] if len(w) <= LONGEST_KEPT else self._ids(w) for w in others]
        other_ids, other_counts = _laid_out([np.frombuffer(x, np.uint32) for x in found])
        counts = np.concatenate([_sums(counts, cells), other_counts])
        order = np.empty(len(plain), np.int64)
        order[np.flatnonzero(plain)] = np.arange(plain.sum())
        order[np.flatnonzero(~plain)] = np.arange(plain.sum(), len(plain))
        return _spread(np.concatenate([ids, other_ids]), counts, order)


def kept(held: dict, make: Callable) -> object:
    """An object made once per Python worker: `held` is a broadcast dictionary, which a worker keeps between tasks."""
    if "made" not in held:
        held["made"] = make(held["source"])
        give_back()  # what making it took, and what the worker did before
    return held["made"]


def forget(held: dict) -> None:
    """Drop what kept() made and return its memory; callers drop their own references first."""
    held.pop("made", None)
    give_back()
