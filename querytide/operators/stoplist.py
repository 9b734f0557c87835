"""Stop list: the word table, its edits, and the substring filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.errors import WordsNotFoundError
from querytide.functions.beginnings import BITS, beginning_bits, places
from querytide.functions.text import contains_any, normalise_word
from querytide.functions.times import as_column
from querytide.session import stored

# Word lists up to this many bytes are written into the filter expression; longer ones are joined.
MAX_INLINE_BYTES = 4_000
# Shortest words of the length classes; a class looks up this many characters.
_CLASSES = (1, 2, 3, 5, 12)
_HASH = "_text_hash"


def normalise(words: DataFrame) -> DataFrame:
    """One row per distinct usable word."""
    clean = words.select(normalise_word(F.col("word")).alias("word"))
    return clean.where(F.col("word") != "").distinct()


def add_words(current: DataFrame, new: DataFrame) -> DataFrame:
    """The list with the new words in it. Known and blank words change nothing."""
    return current.select("word").union(normalise(new)).distinct()


def delete_words(current: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The list without the unwanted words. Raises WordsNotFoundError when none of them is listed."""
    unwanted = normalise(unwanted)
    if current.join(unwanted, "word", "left_semi").isEmpty():
        raise WordsNotFoundError("none of the given words is in the stop list")
    return current.select("word").join(unwanted, "word", "left_anti")


def stop_predicate(text: Column, words: list[str]) -> Column:
    """True where the lower-cased text contains none of the normalised words; an empty list passes all."""
    if not words:
        return F.lit(True)
    return ~F.coalesce(contains_any(F.lower(text), F.lit(words)), F.lit(False))


def short_list(words: DataFrame, max_inline: int = MAX_INLINE_BYTES) -> list[str] | None:
    """The words, if they take up at most `max_inline` bytes; then there are not more of them than bytes."""
    short = F.when(F.octet_length("word") <= max_inline, F.col("word"))
    found = [row.word for row in words.select(short.alias("word")).limit(max_inline + 1).collect()]
    fits = None not in found and sum(len(word.encode()) for word in found) <= max_inline
    return found if fits else None


def with_stop_verdict(
    rows: DataFrame,
    words: DataFrame | list[str],
    text: str = "query",
    verdict: str = "stop_ok",
    max_inline: int = MAX_INLINE_BYTES,
) -> DataFrame:
    """Add a boolean column: false where the text contains a stop word anywhere, also inside a longer word.

    `words` must be normalised. A list of at most `max_inline` bytes, or one that is given as a list, becomes part of the
    expression; a longer one stays a table and is joined; the verdicts are the same.
    """
    listed = words if isinstance(words, list) else short_list(words, max_inline)
    if listed is not None:
        return rows.withColumn(verdict, stop_predicate(F.col(text), listed))
    hits = stored(texts_with_words(rows, words, text), "stop-hits").select(_HASH, F.lit(False).alias(verdict))
    joined = rows.withColumn(_HASH, F.xxhash64(F.lower(text))).join(hits, _HASH, "left").drop(_HASH)
    return joined.withColumn(verdict, F.coalesce(F.col(verdict), F.lit(True)))


def texts_with_words(rows: DataFrame, words: DataFrame, text: str = "query") -> DataFrame:
    """Hashes of the lower-cased texts that contain a word of a list of any length.

    Words are looked up in classes by length, the shortest first, by the characters they begin with, and only in texts
    without a hit so far. A filter of bits, set by the hashes of a class's beginnings, is tested at every position in Arrow
    batches, so a position becomes a row only if a word may begin there. Those are looked up by an equality join;
    where a word begins as the text goes on, the text is fetched by its hash and compared with the whole word. So such a
    position costs a hash, a number and a few characters, and no text is shuffled by position.
    """
    size = F.char_length("word")
    shortest = F.lit(0)
    for least in _CLASSES:
        shortest = F.when(size >= least, F.lit(least)).otherwise(shortest)
    words = words.where(F.col("word") != "").select("word", shortest.alias("_class"))
    words = words.select("word", "_class", F.substr("word", F.lit(1), F.col("_class")).alias("_beginning"))
    filters = _filters(words)
    texts = rows.select(F.lower(text).alias("_lower")).where("_lower IS NOT NULL").distinct()
    texts = stored(texts.select(F.xxhash64("_lower").alias(_HASH), "_lower"), "stop-texts")
    found = None
    for least, bits in sorted(filters.items()):
        beginnings = words.where(F.col("_class") == least).select("word", "_beginning")
        left = texts if found is None else texts.join(found, _HASH, "left_anti")
        possible = _places(left, least, bits).join(beginnings, "_beginning").select(_HASH, "_at", "word")
        whole = F.substr("_lower", "_at", F.char_length("word")) == F.col("word")
        hits = left.join(possible, _HASH).where(whole).select(_HASH).distinct()
        found = stored(hits if found is None else found.union(hits), "stop-found")
    return texts.select(_HASH).limit(0) if found is None else found


def _filters(words: DataFrame) -> dict[int, list[int]]:
    """For each class that has words, the filter as 64-bit numbers: a bit is set for the hash of each beginning."""
    hashed = words.select("_class", "_beginning").mapInArrow(beginning_bits, "_class int, bit bigint")
    at = F.call_function("div", F.col("bit"), as_column(64)).alias("at")
    set_ = F.call_function("shiftleft", as_column(1), F.pmod(F.col("bit"), as_column(64)).cast("int"))
    found: dict[int, list[int]] = {}
    for row in hashed.groupBy("_class", at).agg(F.bit_or(set_).alias("n")).collect():  # as many as the filters are long
        found.setdefault(row["_class"], [0] * (BITS // 64))[row["at"]] = row["n"]
    return found


def _places(texts: DataFrame, size: int, numbers: list[int]) -> DataFrame:
    """Each position of a text at which a word may begin, with the `size` characters from there."""
    # No word of the class is longer than its beginning if the next class takes those with one character more.
    run = places(size, size + 1 in _CLASSES, numbers, [_HASH, "_at", "_beginning"])
    return texts.select(_HASH, "_lower").mapInArrow(run, f"{_HASH} bigint, _at bigint, _beginning string")
