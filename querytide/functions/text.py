"""Text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space at either end, by the Unicode definition (trim() would leave tabs and no-break spaces).
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def normalise_word(word: Column) -> Column:
    """Stop-word form: no white space around it, lower case. A blank word becomes ''."""
    return F.lower(F.regexp_replace(word, _EDGE_SPACE, ""))


def contains_any(text: Column, words: Column) -> Column:
    """True where `text` contains at least one element of the array `words`.

    The one-element array binds `text` once per row; written directly inside the lambda it would be evaluated
    again for every word.
    """
    return F.exists(F.array(text), lambda t: F.exists(words, lambda w: F.contains(t, w)))
