"""Quality rules: one table of thresholds, compiled into one projection.

``MEASURES`` are counts that a text has, ``RULES`` bounds on them or on ratios
of two of them. Both are compiled into columns of built-in functions, so that
one scan judges every document and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it not of on or that the this to was with "
    "als auf aus das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au aux avec dans de des du en est et la le les par pas pour que qui sur un une "
    "al como con de del el en es la las los no para por que se su un una y"
).split()


class Rule(NamedTuple):
    """``low <= 1000 * measure / per <= high``; without ``per`` the bound holds for the measure itself."""

    name: str
    measure: str
    per: str | None
    low: int | None
    high: int | None


#: The table. Ratios are in thousandths.
RULES = (
    Rule("long_words", "word_chars", "n_words", 2000, 14000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("letterless_words", "n_bare_words", "n_words", None, 200),
    Rule("loud_words", "n_loud_words", "n_words", None, 400),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
)

#: below this many words, or above this share of repeated words, nothing else is asked
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the list.

    Windows are compared by their 64-bit hashes. Only when two are equal are
    positions sorted: each repeated window then covers the words up to the next
    repeated one, at most its own length.
    """

    def covered(sorted_windows: Column) -> Column:
        same = lambda x, i, other: (i + other >= 0) & (i + other < F.size(sorted_windows)) & (
            F.get(sorted_windows, i + other)["h"] == x["h"]
        )
        twice = F.filter(sorted_windows, lambda x, i: same(x, i, -1) | same(x, i, 1))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, p: F.struct(
                (s["n"] + p + window - F.greatest(s["end"], p)).alias("n"), (p + window).alias("end")
            ),
            lambda s: s["n"].cast("long"),
        )

    def of(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(
            F.lit(0).cast("long")
        )

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))
    )
    return F.when(F.size(words) > window, let(hashes, of)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every count that a rule may name, of a text, its words and its lines that hold a word."""
    count = lambda items, test: F.size(F.filter(items, test)).cast("long")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": count(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS))),
        "n_bare_words": count(words, lambda w: F.lower(w) == F.upper(w)),
        "n_loud_words": count(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 2)),
        "n_bullet_lines": count(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")),
        "n_cut_lines": count(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")),
    }


def compiled(values: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition over a struct of the measures."""
    passed = F.lit(True)
    for rule in rules:
        value = values[rule.measure] if rule.per is None else 1000 * values[rule.measure]
        unit = F.lit(1) if rule.per is None else values[rule.per]
        if rule.low is not None:
            passed = passed & (value >= rule.low * unit)
        if rule.high is not None:
            passed = passed & (value <= rule.high * unit)
    return passed


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Every measure of a text, ``base_failed`` and ``kept`` as one struct; each part of it is computed once."""

    def counted(value: Column) -> Column:
        words = F.filter(F.split(value, BLANKS), lambda w: w != "")
        lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        named = lambda w, x: F.struct(*(c.alias(n) for n, c in measures(value, w, x).items()))
        return let(words, lambda w: let(lines, lambda x: named(w, x)))

    def judged(values: Column) -> Column:
        failed = (values["n_words"] < MIN_WORDS) | (
            100 * values["n_repeat_words"] > MAX_REPEATED_PERCENT * values["n_words"]
        )
        return F.struct(values.alias("_measures"), failed.alias("base_failed"), (~failed & compiled(values, rules)).alias("kept"))

    measured = let(F.coalesce(text, F.lit("")), counted)
    return let(measured, judged)


def judge(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: the key, every measure, ``base_failed`` and ``kept``.

    Words are runs without ASCII white space. Null and empty texts have no
    words and fail the base rule; repeated rows and keys are judged one by one;
    other columns are not looked at. Results never depend on other rows. A
    generator gives the row out, so that a later filter doesn't judge it again.
    """
    done = df.select(F.col(key), F.inline(F.array(judgement(F.col(text), rules))))
    return done.select(key, "_measures.*", "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` whose text passes, with the columns of ``df``."""
    held = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_judged"))
    judged = judge(held, "_judged", "_row", rules)
    return judged.where("kept").select("_row.*")
