"""Quality rules learned as a decision list, from text statistics to an ordered Spark conditional expression.

Sequential covering over labelled statistics: a rule is grown on two thirds of the labelled documents, one threshold
condition at a time by its estimated precision, and pruned from its end on the other third; it is kept if it is precise there, and the
documents it covers are set aside before the next rule is grown. Every count comes from a DataFrame aggregation over all
labelled rows: candidate thresholds are quantiles, each row becomes its bin per statistic, and one aggregation counts
labels per (statistic, bin). What reaches the driver is those counts, whose number the parameters bound. All of it is
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import GAP, fresh
from querytide.session import stored

#: Fixed values of the base rules: fewest words, most words in repeated windows (percent), words of a window.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Counted characters.
SYMBOLS = "#*$%&|<>"
#: Learned statistics: name and expression over the counts.
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
}
#: Candidate thresholds per statistic, rules tried for a list, conditions of a rule.
THRESHOLDS, MAX_RULES, MAX_CONDITIONS = 32, 8, 4
#: Learning ends when this many rules have failed the pruning rows.
MAX_FAILED = 3
#: Documents of average quality that the estimate of a rule's precision adds to those it covers.
SHRINK = 2
#: A rule must have this share of its covered documents rejected by label on the pruning rows, and cover as many.
MIN_PRECISION, MIN_COVERED = 0.95, 3
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, features: Column) -> Column:
        value = features[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def _count(text: Column, kind: str) -> Column:
    """How many characters of the class `kind` the text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def statistics(text: Column) -> Column:
    """A struct of the counts (`base`) and their ratios (`features`) of a text.

    A null text has no words; ratios of nothing are 0. Windows are compared by 64-bit hash within one text."""

    def of_words(t: Column, words: Column) -> Column:
        return _let(_lines(t), lambda lines: _let(_base(t, words, lines), lambda base: F.struct(
            base.alias("base"), F.struct(*[_ratio(base, e).alias(n) for n, e in FEATURES.items()]).alias("features")
        )))

    cut = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(cut, lambda words: of_words(t, words)))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def _base(t: Column, words: Column, lines: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _count(t, "!?").alias("n_marks"),
        _count(t, r"\p{Lu}").alias("n_capitals"),
        _count(t, "0-9").alias("n_digits"),
    )


def _ratio(base: Column, expression: str) -> Column:
    top, _, bottom = expression.partition(" / ")
    value = base[top].cast("double")
    return F.when(base[bottom] > 0, value / base[bottom]).otherwise(F.lit(0.0)) if bottom else value


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more: equal hashes meet by sorting, then the windows' places are put in
    order and each counts its words up to the next place."""
    n_grams = F.size(words) - (WINDOW - 1)
    grams = F.transform(
        F.sequence(F.lit(0), n_grams - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda pairs: _let(_places(pairs), _words_from))

    some = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
    return F.when(n_grams > 1, some).otherwise(F.lit(0))


def _places(pairs: Column) -> Column:
    def beside(x: Column, i: Column) -> Column:
        return F.coalesce(x["h"] == F.get(pairs, i)["h"], F.lit(False))

    twice = F.filter(pairs, lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _words_from(places: Column) -> Column:
    def upto_next(p: Column, k: Column) -> Column:
        return F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))

    return F.aggregate(F.transform(places, upto_next), F.lit(0), lambda total, x: total + x)


def base_failed(base: Column) -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])


class DecisionList:
    """Ordered rules; a document that any rule covers is rejected."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    def first_rule(self, features: Column) -> Column:
        """The number of the first rule that covers a document, from 1, or 0."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(rule, features), F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        lines = [f"if {' and '.join(map(str, rule))}: reject" for rule in self.rules]
        return "\n".join([*lines, "otherwise: keep"])


def _all(conditions: Rule, features: Column | None = None) -> Column:
    features = F.col("features") if features is None else features
    return reduce(lambda a, b: a & b, (c.column(features) for c in conditions), F.lit(True))


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Learn a list that rejects what `labels` marks with 0 and keeps what it marks with 1.

    `statistics` has the id and the struct `features`. All labelled rows count; null ids and labels other than 0 and 1
    do not; a document with several labels counts once for each. Without labels of both kinds the list is empty."""
    marks = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).alias("bad")).filter(
        F.col(label_col).isin(0, 1)
    )
    known = statistics.select(F.col(id_col).alias("doc_id"), "features").join(marks, "doc_id")
    known = known.withColumn("pruning", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    known = stored(known, "decision-list")
    names = list(FEATURES)
    shares = [(k + 1) / (THRESHOLDS + 1) for k in range(THRESHOLDS)]
    cuts_row = known.agg(*[F.percentile_approx(f"features.{n}", shares).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts_row[n] or [])) for n in names}
    bins = [
        F.lit(0) + sum((F.col(f"features.{n}") > F.lit(c)).cast("int") for c in cuts[n]) for n in names
    ]
    binned = known.withColumn("bins", F.array(*bins))

    rules: list[Rule] = []
    open_rows, failed = binned, set()
    for _ in range(MAX_RULES):
        grown = _grow(open_rows.filter("NOT pruning"), cuts, failed)
        if not grown:
            break
        if rule := _prune(open_rows.filter("pruning"), grown):
            rules.append(rule)
            open_rows = open_rows.filter(~_all(rule))
        else:
            failed.add((grown[0].feature, grown[0].above))
            if len(failed) == MAX_FAILED:
                break
    return DecisionList(rules)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], failed: set[tuple[str, bool]]) -> Rule:
    """A rule whose first condition is not on a side of a statistic that `failed` has."""
    names, rule, worth = list(cuts), (), -1.0
    while len(rule) < MAX_CONDITIONS:
        counts = rows.filter(_all(rule)).select("bad", F.posexplode("bins").alias("feature", "bin"))
        table: dict[int, dict[int, list[int]]] = {}
        for r in counts.groupBy("feature", "bin", "bad").count().collect():
            table.setdefault(r["feature"], {}).setdefault(r["bin"], [0, 0])[not r["bad"]] += r["count"]
        bad, good = (sum(x[k] for x in table.get(0, {}).values()) for k in (0, 1))
        if not bad or not good:
            break
        if not rule:
            prior = bad / (bad + good)
            worth = prior
        best = None
        for f in sorted(table):
            below = [0, 0]
            for k, cut in enumerate(cuts[names[f]]):
                below = [below[j] + table[f].get(k, (0, 0))[j] for j in (0, 1)]
                for above, p, n in ((False, *below), (True, bad - below[0], good - below[1])):
                    precision = (p + SHRINK * prior) / (p + n + SHRINK)
                    if precision > worth + 1e-9 and (rule or (names[f], above) not in failed):
                        best, worth = Condition(names[f], above, cut), precision
        if best is None:
            break
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of the rule that separates the pruning rows best, or () if that is not precise enough."""
    if not rule:
        return ()
    sums = []
    for k in range(1, len(rule) + 1):
        for bad in (True, False):
            sums.append(F.count_if(_all(rule[:k]) & (F.col("bad") == F.lit(bad))))
    counts = rows.agg(*[c.alias(str(i)) for i, c in enumerate(sums)]).first()
    best, kept = -2.0, ()
    for k in range(1, len(rule) + 1):
        p, n = counts[2 * k - 2], counts[2 * k - 1]
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, rule[:k] if p >= MIN_COVERED and p >= MIN_PRECISION * (p + n) else ()
    return kept


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit the list on the labelled documents and judge all.

    Returns doc_id, the five base counts, base_failed, rule (the first rule that covers the document, from 1, or 0) and
    kept, one row per row of `docs`; null and repeated ids are judged like any other, an empty table gives none. Other
    columns are left out, so their names cannot clash."""
    counted = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("s"))
    counted = stored(counted.select("doc_id", "s.*"), "statistics")
    rule = fit(counted, labels).first_rule(F.col("features"))
    judged = counted.select(
        "doc_id",
        *[F.col(f"base.{c}").alias(c) for c in _COUNTS],
        base_failed(F.col("base")).alias("base_failed"),
        rule.alias("rule"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the base rules and the fitted list keep, with all columns of `docs`.

    The list is fitted on the labelled documents among `docs`. Every text is read once: the rows are written with their
    statistics, the fit reads those without the texts, and the filter reads both. A null or empty text has no words and
    is rejected, as are all repeats of a rejected row; null ids are judged by their text and take no part in the fit."""
    name = fresh(docs.columns, "statistics")
    counted = stored(docs.withColumn(name, statistics(F.col(text_col))), "documents-and-statistics")
    rules = fit(counted.select(F.col(id_col).alias("doc_id"), F.col(f"{name}.features").alias("features")), labels)
    kept = ~base_failed(F.col(f"{name}.base")) & (rules.first_rule(F.col(f"{name}.features")) == 0)
    return counted.filter(kept).drop(name)
