"""Equal and near-equal lines across a corpus by a segment-partition edit join.

Equal lines of every length are found by grouping on the line. Near lines may differ by DISTANCE edits from MIN_CHARS
code points on; the edits fall in proportion for shorter lines (one from half of it, then none), so that lines that
differ in much of their text are not joined.

Two lines within d edits share, unchanged and almost in place, one of the d + 1 segments that either is
cut into (pigeonhole). Each distinct line is stored under its segments, keyed by its length, the segment's number and
text (own keys), and looks up, for its own length and each smaller one within reach, the substrings of its own that can
be such a segment (other keys): only those few start places that leave room for the edits on both sides. Lines that meet, and whose numbers of
some letters allow it, are compared by a bit-parallel edit distance that gives up beyond the edits of the shorter one.

Equal lines are one row before the join. A key that very many lines share (a family of numbered lines, say) is cut into
blocks of lines, and blocks are paired, so no task holds a key's lines at once; a block gives each line its earliest near
line, and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import Cache, Powers, fresh, mixed, signed
from querytide.session import stored

#: Edits within which two lines count as the same, and the shortest line (code points) that may have all of them.
DISTANCE, MIN_CHARS = 2, 24
#: Keys of more lines than HOT are not paired by a join but in blocks of BLOCK lines.
HOT, BLOCK = 64, 256
#: Letters whose numbers are compared before two lines are paired (frequent ones of several languages).
COUNTED = "etaonisr"
#: Bytes of lines whose keys are made together; a longer line is cut by itself. The counts of letters fit into 16 bits.
GROUP_BYTES = (1 << 16) - 1
#: Pairs up to which the numbers of their lines are broadcast (16 bytes a pair).
MAX_SENT = 500_000


def edit_distance(a: str, b: str, limit: int) -> int:
    """The edit distance of a and b if it is at most `limit`, else limit + 1.

    Equal ends are cut off, then the columns of the table are kept as two bit vectors of one machine word per 64 rows
    (Python's integers); the loop ends as soon as the rest cannot bring the distance back within the limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    first, last = 0, 0
    shorter = min(len(a), len(b))
    while first < shorter and a[first] == b[first]:
        first += 1
    while last < shorter - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    n = len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    # Band: row i of a is seen only while column j is within `limit` of it, so characters enter as the band reaches them.
    for i in range(min(n, limit)):
        places[a[i]] = places.get(a[i], 0) | 1 << i
    for j, c in enumerate(b):
        if j + limit < n:
            places[a[j + limit]] = places.get(a[j + limit], 0) | 1 << (j + limit)
        equal = places.get(c, 0)
        vertical = equal | minus
        cross = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(cross | plus)), plus & cross
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score - (len(b) - 1 - j) > limit:
            return limit + 1
    return min(score, limit + 1)


def _segment(length: int, i: int, distance: int) -> tuple[int, int]:
    """First place (from 0) and size of segment i of a line: even sizes, the longer ones last."""
    parts = distance + 1
    size, longer = divmod(length, parts)
    return size * i + max(0, longer - (parts - i)), size + (longer >= parts - i)


def allowed(length: int, distance: int, min_chars: int) -> int:
    """Edits by which a line may differ from one that is as long or longer."""
    return min(distance, distance * length // max(1, min_chars), length - 1)


def _allowed(length: Column, distance: int, min_chars: int) -> Column:
    return F.least(F.lit(distance), F.floor(length * distance / max(1, min_chars)), length - 1)


def _places(length: int, distance: int, min_chars: int) -> list[tuple[int, int, int, bool]]:
    """(first, end, seed, own) of the substrings of a line that are its keys; the seed stands for a segment's line length
    and number. Its own segments come first, then what may be a segment of a line of this length or up to `distance`
    shorter. A shift beyond the first bound leaves too few edits before the segment, beyond the second too few after."""
    found = []
    for less in range(distance + 1):
        other = length - less
        d = allowed(other, distance, min_chars)
        for i in range(d + 1 if d > 0 and less <= d else 0):
            start, size = _segment(other, i, d)
            for shift in range(max(-i, less - (d - i)), min(i, less + (d - i)) + 1):
                if start + shift >= 0 and start + shift + size <= length:
                    own = less == shift == 0
                    found.append((start + shift, start + shift + size, other * (distance + 1) + i, own))
    return sorted(found, key=lambda place: not place[3])


class Keys:
    """Keys of lines: 64-bit hashes of substrings with the length and number of the segment that they may be. Bytes are
    numbers of a rolling sum, so lines that stand together are cut all at once."""

    def __init__(self, distance: int, min_chars: int, own: bool, bare: bool = False) -> None:
        def places(length: int) -> np.ndarray:
            found = [p[:3] for p in _places(length, distance, min_chars) if p[3] == own]
            return np.array(found, np.int64).reshape(-1, 3)

        self.places, self.powers, self.bare = Cache(places, 20_000), Powers(), bare
        self.letters = np.zeros(256, np.uint64)
        for k, c in enumerate(COUNTED):
            self.letters[ord(c)] = 1 << 8 * k

    def __call__(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many keys each line has, the bags of the lines (left at 0 if `bare`), and the keys. No line is empty."""
        lines = lines.cast(pa.large_binary())
        ends, first, found = np.cumsum(np.asarray(pc.binary_length(lines))), 0, []
        while first < len(lines):
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
            group = lines.slice(first, end - first)
            found.append(self._group(group) if ends[end - 1] - before <= GROUP_BYTES else self._long(group[0].as_py()))
            first = end
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
        return tuple(np.concatenate(parts) for parts in zip(nothing, *found, strict=True))

    def _key(self, sums: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return mixed(sums + mixed(seeds.astype(np.uint64)))

    def _group(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, 8 * lines.offset)
        text = np.frombuffer(lines.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
        offsets = offsets - offsets[0]
        # Places of the code points, and the first code point of each line.
        points = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
        starts = np.searchsorted(points, offsets)
        lengths, kinds = np.unique(np.diff(starts), return_inverse=True)
        tables = [self.places[n] for n in lengths.tolist()]
        sizes = np.array([len(t) for t in tables], np.int64)
        counts = sizes[kinds]
        rows = np.repeat(np.arange(len(lines)), counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        cuts = np.concatenate(tables)[np.repeat((np.cumsum(sizes) - sizes)[kinds], counts) + within]
        from_, to = (points[starts[rows] + cuts[:, i]] for i in range(2))
        prefix = self.powers.prefix(text.astype(np.uint64))
        bags = np.zeros(len(lines), np.int32) if self.bare else self._bags(text, offsets)
        return counts, bags, self._key(self.powers.spans(prefix, from_, to), cuts[:, 2])

    def _bags(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How often each line has each of the COUNTED letters, modulo 16."""
        # Of 255 bytes at a time, so that eight numbers fit into one; sums of a line are kept in 16 bits.
        blocks = -(np.diff(offsets) // -255)
        first = np.cumsum(blocks) - blocks
        within = np.arange(blocks.sum()) - np.repeat(first, blocks)
        sums = np.add.reduceat(self.letters[text], np.repeat(offsets[:-1], blocks) + 255 * within)
        bags = np.zeros(len(blocks), np.uint64)
        for odd in range(2):
            numbers = np.add.reduceat(sums >> np.uint64(8 * odd) & np.uint64(0x00FF00FF00FF00FF), first)
            for k in range(odd, len(COUNTED), 2):
                bags |= (numbers >> np.uint64(8 * (k - odd)) & np.uint64(15)) << np.uint64(4 * k)
        return bags.astype(np.uint32).view(np.int32)

    def _long(self, line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = line.decode("utf-8", "replace")
        cuts = self.places[len(text)]
        sums = np.array([self._sum(text[a:b].encode()) for a, b, _ in cuts], np.uint64)
        bag = sum((text.count(c) & 15) << 4 * k for k, c in enumerate(COUNTED))
        return np.array([len(cuts)]), np.array([bag], np.uint32).view(np.int32), self._key(mixed(sums), cuts[:, 2])

    def _sum(self, data: bytes) -> int:
        """The rolling sum of all bytes, some of them at a time."""
        total, up = 0, 1
        for i in range(0, len(data), GROUP_BYTES):
            part = np.frombuffer(data, np.uint8, min(GROUP_BYTES, len(data) - i), i)
            total += int(self.powers.prefix(part.astype(np.uint64))[-1]) * up
            up = up * pow(self.powers.base, len(part), 1 << 64) % (1 << 64)
        return total % (1 << 64)


def _keyed(lines: DataFrame, distance: int, min_chars: int, own: bool, bare: bool = False) -> DataFrame:
    """id, bag and key, or key alone if `bare`: a row for each of a line's own keys, or for each of its other keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Keys(distance, min_chars, own, bare)
        for batch in batches:
            counts, bags, keys = made(batch.column(1))
            columns = {"key": signed(keys)}
            if not bare:
                columns |= {"id": np.repeat(batch.column(0).to_numpy(), counts), "bag": np.repeat(bags, counts)}
            yield pa.RecordBatch.from_pydict({name: pa.array(columns[name]) for name in names})

    names = ["key"] if bare else ["id", "bag", "key"]
    schema = ", ".join(f"{name} {'int' if name == 'bag' else 'long'}" for name in names)
    return lines.select("id", "line").mapInArrow(run, schema)


def _occurrences(docs: DataFrame) -> DataFrame:
    """row, place (order of the line in the corpus), number, id and line of every line that is not blank."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("number")
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).filter("line <> ''")
    return lines.select("row", place.cast("decimal(38,0)").alias("place"), "number", F.xxhash64("line").alias("id"), "line")


def _alike(a: str, b: str, distance: int) -> Column:
    """Whether the letters' numbers allow the distance: an edit changes them by two at most. A bag has them modulo 16, so
    they differ by what their remainders differ by, the short way round, at least."""

    def part(bag: str, k: int) -> Column:
        return F.shiftrightunsigned(bag, 4 * k).bitwiseAND(F.lit(15))

    apart = [F.abs(part(a, k) - part(b, k)) for k in range(len(COUNTED))]
    apart = [F.least(x, 16 - x) for x in apart]
    return sum(apart[1:], apart[0]) <= 2 * distance


def _near(lines: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """id and place: for each line with others within the distance, the earliest place of those."""
    lines = lines.filter(_allowed(F.length("line"), distance, min_chars) > 0)
    own, other = (_keyed(lines, distance, min_chars, alone) for alone in (True, False))
    counts = _keyed(lines, distance, min_chars, own=True, bare=True).groupBy("key").count()
    hot = stored(counts.filter(F.col("count") > HOT).withColumnRenamed("count", "n"), "hot-keys")

    # Own keys are shuffled once and meet each other, then the other keys.
    usual = own.join(hot, "key", "left_anti")
    left, right = (usual.withColumnsRenamed({"id": x, "bag": f"bag_{x}"}) for x in "ab")
    other_side = other.withColumnsRenamed({"id": "b", "bag": "bag_b"})
    pairs = left.join(right, "key").filter("a < b").unionByName(left.join(other_side, "key").filter("a <> b"))
    pairs = pairs.filter(_alike("bag_a", "bag_b", distance))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    texts = lines.select("id", "line", "place")
    # The numbers of few lines are sent to the texts; many meet them by a shuffle.
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    met = F.broadcast(met) if pairs.count() <= MAX_SENT else met
    met = stored(texts.join(met, "id", "left_semi"), "met-lines")
    half = pairs.join(met.withColumnsRenamed({"id": "a", "line": "x", "place": "px"}), "a")
    both = half.join(met.withColumnsRenamed({"id": "b", "line": "y", "place": "py"}), "b")
    links = both.select("a", "b", "x", "y", "px", "py").mapInArrow(_verifier(distance, min_chars), "id long, place decimal(38,0)")
    if hot.isEmpty():
        return links.groupBy("id").agg(F.min("place").alias("near"))

    own, every = own.drop("bag"), own.union(other).drop("bag")
    left = own.join(hot, "key").join(texts, "id").withColumn("own", F.lit(True))
    right = every.join(hot, "key").join(texts, "id").withColumn("own", F.lit(False))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = left.withColumn("i", mine).withColumn("j", others).unionByName(right.withColumn("j", mine).withColumn("i", others))
    dealt = dealt.select("key", "i", "j", "own", "id", "line", "place")
    in_blocks = dealt.groupBy("key", "i", "j").applyInArrow(_block(distance, min_chars), "id long, place decimal(38,0)")
    return links.union(in_blocks).groupBy("id").agg(F.min("place").alias("near"))


def _same(a: str, b: str, distance: int, min_chars: int) -> bool:
    limit = allowed(min(len(a), len(b)), distance, min_chars)
    return edit_distance(a, b, limit) <= limit


def _verifier(distance: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            ids, places = [], []
            for a, b, x, y, px, py in zip(*(rows[c] for c in ("a", "b", "x", "y", "px", "py")), strict=True):
                if _same(x, y, distance, min_chars):
                    ids += [a, b]
                    places += [py, px]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places, pa.decimal128(38, 0))], names=["id", "place"]
            )

    return run


def _block(distance: int, min_chars: int):
    """For each line of a block, the earliest line before it that is near: lines are tried in their order, up to the
    first that is near."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        own, others = ([r for r in rows if r["own"] == side] for side in (True, False))
        best: dict[int, object] = {}
        for lines, earlier in ((others, own), (own, others)):
            for line in lines:
                for found in earlier:
                    if found["place"] >= best.get(line["id"], line["place"]):
                        break
                    if _same(found["line"], line["line"], distance, min_chars):
                        best[line["id"]] = found["place"]
                        break
        return pa.table(
            {"id": pa.array(list(best), pa.int64()), "place": pa.array(list(best.values()), pa.decimal128(38, 0))}
        )

    return run


def repeated_lines(
    docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The lines that repeat an earlier line of the corpus, exactly or within `distance` edits.

    Earlier is by id, then by line number. A line counts without blanks at its ends, and a blank one not at all. The
    shorter of two lines sets the edits they may differ by: all from `min_chars` code points on, fewer in proportion
    below; exact repeats have no bound. All near lines of a line count, repeated or not, but not theirs in turn. Returns row (hash of id and
    text) and lines (ascending numbers from 0, as split at line feeds) for documents that have such lines. Null texts
    have no lines. Rows without an id are neither earlier than others nor looked at; rows that are equal in id and text
    are one document. Distinct lines are told apart by their text, and named by a 64-bit hash. An empty table gives
    none."""
    chosen = docs.select(
        F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    found = _occurrences(chosen.filter("doc_id IS NOT NULL"))
    lines = found.groupBy("line").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    lines = stored(lines.select(F.xxhash64("line").alias("id"), "line", "place", "last"), "lines", compression="zstd")
    near = stored(_near(lines, distance, min_chars), "near-lines")
    first = F.least("place", F.coalesce("near", "place"))
    first = lines.select("id", "place", "last").join(near, "id", "left").select("id", first.alias("first"), "last")
    first = stored(first.filter("first < last").select("id", "first"), "first-places")
    repeats = found.select("row", "place", "number", "id").join(first, "id").filter("place > first")
    return repeats.groupBy("row").agg(F.sort_array(F.collect_set("number")).alias("lines"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """doc_id, n_lines (as split at line feeds), n_removed and removed_lines (their numbers, comma-joined), one row per
    row of `docs`. Other columns are left out, so their names cannot clash."""
    removed = repeated_lines(docs, id_col=id_col, text_col=text_col, **kwargs)
    n_lines = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_lines.alias("n_lines"), F.xxhash64(id_col, text_col).alias("row"))
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    out = rows.join(removed, "row", "left").select("doc_id", "n_lines", lines.alias("lines"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("lines").cast("long").alias("n_removed"),
        F.array_join(F.col("lines").cast("array<string>"), ",").alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """`docs` without the repeated lines, with all its columns in order; texts without such lines stay as they are."""
    removed = repeated_lines(docs, id_col=id_col, text_col=text_col, **kwargs)
    row, lines = fresh(docs.columns, "row_"), fresh(docs.columns, "lines_")
    keyed = docs.withColumn(row, F.xxhash64(id_col, text_col))
    keyed = keyed.join(removed.select(F.col("row").alias(row), F.col("lines").alias(lines)), row, "left")
    kept = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return keyed.withColumn(text_col, text).select(*docs.columns)
