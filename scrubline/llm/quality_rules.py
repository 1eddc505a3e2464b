"""Quality rules as a threshold table, compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[ \t-\r]+"
#: Common short words of the languages at hand; a ratio counts any of them.
STOP_WORDS = (
    "the of and to in that is it for with was on be as at by this from or an are "
    "der die das und den ist von mit ein eine zu auf für im sich "
    "le la les de des et du un une que qui dans pour par sur est "
    "el los las y en se del con su para como no por lo"
).split()


class Rule(NamedTuple):
    """A document passes if ``low <= measure <= high``; None: no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line with a word.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.25),
    Rule("exclamations", "exclamations_per_word", None, 0.3),
    Rule("stop_words", "stop_words_per_word", 0.01, None),
    Rule("repeated_lines", "duplicate_line_share", None, 0.3),
    Rule("bullets", "bullet_line_share", None, 0.9),
    Rule("ellipses", "ellipsis_line_share", None, 0.3),
)
BASE_RULES = (Rule("words", "n_words", 50, None), Rule("repeated_words", "repeat_word_share", None, 0.5))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first one included.

    Equal windows have equal hashes, so a text without equal hashes has none. Otherwise
    windows are sorted by their words (which hold no space) with their places; a window
    equal to a neighbour occurs again, and the places, in order, cover three words each,
    overlaps once.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))
    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("w"), i.alias("p"))))
    again = lambda s: F.filter(s, lambda x, k: (
        F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))),
        F.lit(0), lambda a, b: a + b)
    places = lambda s: F.sort_array(F.transform(again(s), lambda x: x["p"]))
    exact = _let(ordered, lambda s: _let(places(s), covered))
    distinct = _let(hashes, lambda h: F.size(F.array_distinct(h)))
    return F.when(F.size(words) < 3, 0).when(distinct == F.size(words) - 2, 0).otherwise(exact).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and all measures of every whole text; null texts measure like empty ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col), text.alias("_t"), F.array_remove(F.split(text, _SPACE), "").alias("_w"), _lines(text).alias("_l"))
    per = lambda n, d: F.coalesce(F.try_divide(F.col(n), F.col(d)), F.lit(0.0))
    share = lambda pattern: F.coalesce(F.try_divide(
        F.size(F.filter("_l", lambda x: x.rlike(pattern))), F.size("_l")), F.lit(0.0))
    # One set of stop words; a word counts in lower case without marks around it.
    stop = r"(?i)(?<![^ \t-\r])\p{P}*(?:" + "|".join(STOP_WORDS) + r")(?=\p{P}*(?:[ \t-\r]|\z))"
    counts = cut.select(
        id_col, "_l", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), "[#*$%&|<>]+").alias("n_symbols"), _count(F.col("_t"), "!+").alias("n_exclamations"),
        F.regexp_count("_t", F.lit(stop)).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        share(r"^[ \t-\r]*[-*•]").alias("bullet_line_share"),
        share(r"(?:\.\.\.|…)[ \t-\r]*$").alias("ellipsis_line_share"),
    )
    return counts.select(
        "*", per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_exclamations", "n_words").alias("exclamations_per_word"),
        per("n_stop_words", "n_words").alias("stop_words_per_word"),
        per("n_repeat_words", "n_words").alias("repeat_word_share"),
        per("n_dup_lines", "n_lines").alias("duplicate_line_share"),
    ).drop("_l")


def _passes(rule: Rule) -> Column:
    bounds = [F.col(rule.measure) >= rule.low] if rule.low is not None else []
    if rule.high is not None:
        bounds.append(F.col(rule.measure) <= rule.high)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def failed(rules: Sequence[Rule]) -> Column:
    """The names of the rules a row of measures fails, in the order of the table."""
    return F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string")))


def judged(
    docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All measures with ``base_failed``, ``kept`` and the ``failed`` rules of every row.

    A row is kept if it fails neither the base nor the other rules. Null and empty texts
    have no words. Repeated rows get equal results, null ids are kept as they are, an empty
    table gives an empty result, and further columns of ``docs`` are not read.
    """
    rows = measured(docs, id_col, text_col).withColumn("failed", failed([*base, *rules]))
    names = F.array(*[F.lit(r.name) for r in base]) if base else F.array().cast("array<string>")
    return rows.withColumn("base_failed", F.arrays_overlap("failed", names)).withColumn("kept", F.size("failed") == 0)
