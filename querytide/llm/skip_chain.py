"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels a document's words that hold a digit or an at sign: neighbouring
words are linked in a chain, and words that are equal or alike (the same last digits, the same mailbox) are linked over
any distance: each to the last one before it and to one that all are linked to, the first with a base label if there is
one, so that any two are two links apart however often a word repeats. Loopy message passing spreads what the base spans tell, so that a number written once more without its
plus sign, or in another grouping, gets the same label. Words of base spans keep their label; other words that get a
label with high probability become additional spans.

The field is trained here, factor by factor, with the base spans as labels: the word factor by logistic regression over
shapes (which do not show the sign that made the pattern match), the two link factors from the labels of linked words.
Training uses a sample of documents, and of its shapes the most frequent; both bounds are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import as_bytes

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample (as expected from its rate), and the most frequent of its shapes that are fitted.
SAMPLE_DOCS, SAMPLE_SHAPES = 4000, 20_000
#: Rounds of message passing, damping of a message, probability from which a word becomes a span.
ROUNDS, DAMPING, PROBABILITY = 12, 0.3, 0.9
#: Weight of the labels that a word of a base span does not have: below what any number of alike words can outweigh.
HELD = -1e9
#: Fewest digits of an additional span.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}
_SLOTS, _BATCH_BYTES = 1 << 14, 4 << 20

# The base patterns. Digits and separators are taken greedily; possessive forms match the same text.
_MAILBOX = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME, _BLANK, _DIGITS = re.compile(r"[0-9@]"), re.compile(r"\s"), re.compile(r"[^0-9]+")
_EDGES = "\"'`.,;:!?<>[]{}|*=#&$%/\\"

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in _MAILBOX:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            last = found.end()
            yield first, last
        at = text.find("@", max(at + 1, last))


def _is_ip(found: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))


def is_luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns: by kind, then by start."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if len(m[0]) >= 16 else ""
        if 16 <= len(digits) <= 19 and is_luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return spans


class Words:
    """A document's words with a digit or an at sign: places, base labels (0 none), features and links."""

    def __init__(self, text: str, base: list[Span]) -> None:
        self.places: list[tuple[int, int]] = []
        at = 0
        while found := _SOME.search(text, at):
            first = found.start()
            while first > at and not text[first - 1].isspace():
                first -= 1
            end = _BLANK.search(text, found.end())
            at = end.start() if end else len(text)
            self.places.append((first, at))
        n = len(self.places)
        self.labels = [0] * n
        order = sorted(base, key=lambda s: s[1])
        k = 0
        for i, (first, last) in enumerate(self.places):
            while k < len(order) and order[k][2] <= first:
                k += 1
            for kind, a, b in order[k : k + 4]:
                if a < last and b > first:
                    self.labels[i] = kind + 1
                    break
        self.cores = [text[a:b].strip(_EDGES) for a, b in self.places]
        shapes = [_shape(c) for c in self.cores]
        self.chain = [(i, i + 1) for i in range(n - 1) if self._touch(text, i)]
        after = {i: shapes[j] for i, j in self.chain}
        before = {j: shapes[i] for i, j in self.chain}
        self.features = []
        for i, (core, shape) in enumerate(zip(self.cores, shapes, strict=True)):
            digits = _DIGITS.sub("", core)
            luhn = len(digits) >= 12 and is_luhn(digits)
            named = (f"s{shape}", f"n{min(len(digits), 20)}", f"l{luhn}", f"b{before.get(i)}", f"a{after.get(i)}", f"x{shape}{luhn}{before.get(i)}{after.get(i)}")
            self.features.append([xxhash.xxh32_intdigest(f) % _SLOTS for f in named])
        self.skips = []
        keys = [_keys(c) for c in self.cores]
        last_with: dict[str, int] = {}
        hubs: dict[str, int] = {}
        for i, own in enumerate(keys):
            for key in own:
                if key not in hubs or self.labels[i] and not self.labels[hubs[key]]:
                    hubs[key] = i
        for i, own in enumerate(keys):
            linked = {i}
            for key in own:
                for j in (last_with.get(key), hubs[key]):
                    # Two hubs meet once, from the later one.
                    if j is not None and j not in linked and not (j > i and i in (hubs[k] for k in own)):
                        linked.add(j)
                        self.skips.append((min(i, j), max(i, j)))
                last_with[key] = i
        self.skips = list(dict.fromkeys(self.skips))

    def unsure(self) -> set[int]:
        """Words without a label that are like a labelled one, and their neighbours: the patterns do not settle what
        they are, so they are left out of training."""
        alike = {i for pair in self.skips for i, j in (pair, pair[::-1]) if self.labels[j] and not self.labels[i]}
        return alike | {i for pair in self.chain for i, j in (pair, pair[::-1]) if j in alike and not self.labels[i]}

    def _touch(self, text: str, i: int) -> bool:
        between = text[self.places[i][1] : self.places[i + 1][0]]
        return len(between) <= 2 and "\n" not in between


def _shape(core: str) -> str:
    """Digits as 9, letters as a, runs of over four cut to four; signs as they are, but no plus or at sign."""
    kinds = ("9" if c.isdigit() else "a" if c.isalpha() else c for c in core[:64] if c not in "+@")
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", "".join(kinds))


def _keys(core: str) -> list[str]:
    """What alike words share: the text itself, the last digits, or the mailbox."""
    keys = [core.lower()] if len(core) >= 4 else []
    digits = _DIGITS.sub("", core)
    if len(digits) >= 4:
        keys.append("#" + digits[-7:])
    mailbox = core.lower().partition("@")[0]
    if len(mailbox) >= 6 and mailbox not in keys:
        keys.append(mailbox)
    return keys


class Field:
    """The trained factors: weights of features by label, and link factors between labels."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, words: Words) -> np.ndarray:
        """Probability of each label of each word, by loopy message passing; base labels are held."""
        n, k = len(words.places), len(KINDS) + 1
        unary = np.array([self.weights[f].sum(axis=0) for f in words.features])
        for i, label in enumerate(words.labels):
            if label:
                unary[i] = HELD
                unary[i, label] = 0.0
        links = [*words.chain, *words.skips]
        if links:
            a, b = np.array(links).T
            factors = np.concatenate(
                [np.repeat(m[None], len(x), axis=0) for m, x in ((self.chain, words.chain), (self.skip, words.skips))]
            )
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            factors = np.concatenate([factors, factors.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, messages)
                out = belief[source] - messages[back]
                new = np.logaddexp.reduce(out[:, :, None] + factors, axis=1)
                new -= new.max(axis=1, keepdims=True)
                messages = DAMPING * messages + (1 - DAMPING) * new
            np.add.at(unary, target, messages)
        odds = np.exp(unary - unary.max(axis=1, keepdims=True))
        return (odds / odds.sum(axis=1, keepdims=True)).reshape(n, k)


def more_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans of words outside the base spans that the field labels, neighbours of the same label as one span."""
    words = Words(text, base)
    if not words.places:
        return []
    odds = field.marginals(words)
    best = odds.argmax(axis=1)
    linked = dict(words.chain)
    spans: list[Span] = []
    i = 0
    while i < len(best):
        j = i
        while linked.get(j) == j + 1 and best[j + 1] == best[i] and not words.labels[j + 1]:
            j += 1
        sure = best[i] and not words.labels[i] and odds[i : j + 1, best[i]].max() >= PROBABILITY
        if sure:
            kind = int(best[i]) - 1
            raw = text[words.places[i][0] : words.places[j][1]]
            start = words.places[i][0] + len(raw) - len(raw.lstrip(_EDGES))
            stop = start + len(raw.strip(_EDGES))
            apart = all(b <= start or a >= stop for _, a, b in base)
            if apart and len(_DIGITS.sub("", text[start:stop])) >= LEAST_DIGITS[KINDS[kind]]:
                spans.append((kind, start, stop))
        i = j + 1
    return spans


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_shapes: int = SAMPLE_SHAPES) -> Field:
    """Fit the factors on about `sample_docs` documents chosen by the hash of their text.

    What reaches the driver is counted: the `sample_shapes` most frequent feature sets with their labels, and the labels
    at both ends of links."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < round(share * 1_000_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(0)):
                text = data.decode("utf-8", "replace")
                words = Words(text, base_spans(text))
                labels = words.labels
                unsure = words.unsure()
                own = {("word", tuple(f), labels[i], 0) for i, f in enumerate(words.features) if i not in unsure}
                for kind, links in (("chain", words.chain), ("skip", words.skips)):
                    own |= {(kind, (), labels[a], labels[b]) for a, b in links if not unsure & {a, b}}
                rows += sorted(own)  # once per document, however often it repeats a number
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            types = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "features", "a", "b"])

    found = chosen.mapInArrow(run, "part string, features array<int>, a int, b int")
    counts = found.groupBy("part", "features", "a", "b").count()
    rows = counts.orderBy((F.col("part") == "word").cast("int"), F.desc("count"), "features", "a").limit(sample_shapes)
    rows = rows.collect()
    k = len(KINDS) + 1
    factors = []
    for part in ("chain", "skip"):
        joint = np.full((k, k), 0.05)
        for r in rows:
            if r["part"] == part:
                joint[r["a"], r["b"]] += r["count"] / 2
                joint[r["b"], r["a"]] += r["count"] / 2
        joint += np.eye(k)  # alike words are expected to have the same label before any are seen
        joint /= joint.sum()
        factors.append(np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))))
    words = [r for r in rows if r["part"] == "word"]
    return Field(_logistic(words, k), *factors)


def _logistic(rows: list, k: int, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a multinomial logistic regression over counted feature sets; unseen features weigh nothing, and every
    label but none starts from a low prior that is spread over the features of a word."""
    weights = np.zeros((_SLOTS, k))
    weights[:, 1:] = -0.5
    if not rows:
        return weights
    features = np.array([r["features"] for r in rows])
    labels, counts = np.array([r["a"] for r in rows]), np.array([float(r["count"]) for r in rows])
    counts /= counts.sum()
    wanted = np.eye(k)[labels]
    squares = np.full((_SLOTS, k), 1e-8)
    start = weights.copy()
    for _ in range(rounds):
        scores = weights[features].sum(axis=1)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - wanted) * counts[:, None]
        step = penalty * (weights - start) / len(rows)
        np.add.at(step, features.ravel(), np.repeat(error, features.shape[1], axis=0))
        squares += step * step
        weights -= rate * step / np.sqrt(squares)
    return weights


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and additional spans of every whole text.

    Returns doc_id and spans (array of kind, start, end, base; code points, end exclusive; by kind as in KINDS, then by
    start), one row per row of `docs`. A null text is empty and has none; null and repeated ids are kept. The field runs on
    every document that has a word with a digit or an at sign, with or without base spans. Other columns are left out, so
    their names cannot clash. An empty table gives none."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trained = train(chosen)
    factors = docs.sparkSession.sparkContext.broadcast((trained.weights, trained.chain, trained.skip))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*factors.value)
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                text = data.decode("utf-8", "replace")
                base = base_spans(text)
                more = more_spans(text, base, field)
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return chosen.mapInArrow(run, schema)


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of find_personal_data()'s rows."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda s: s["base"]), [of_kind(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
