"""The text cleaning plan: a fixed chain of steps in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.functions import text as X
from scrubline.options import TextOptions


def text_steps(options: TextOptions) -> list[tuple[str, Callable[[Column], Column]]]:
    """The enabled steps with their labels, in running order."""
    functions = {
        "strip_html": X.strip_html,
        "remove_urls": X.remove_urls,
        "remove_emails": X.remove_emails,
        "remove_phone": X.remove_phone_numbers,
        "remove_emojis": X.remove_emojis,
        "remove_special_chars": lambda c: X.remove_special_characters(c, options.keep_basic_punctuation),
        # strings in the engine are valid already; bytes are repaired at the scan
        "remove_non_utf8": lambda c: c,
        "replace_whitespace": X.replace_special_whitespace,
        "replace_escape": X.replace_escape_characters,
        "normalize_case": lambda c: X.normalize_case(c, options.case_mode),
        "remove_spaces": lambda c: X.remove_extra_spaces(c, options.keep_paragraphs),
        "remove_linebreaks": X.remove_extra_linebreaks,
    }
    return [
        (V.TEXT_STEP_LABELS[name].format(mode=options.case_mode), f)
        for name, f in functions.items()
        if getattr(options, name)
    ]


def clean_text(
    df: DataFrame, column: str = "text", options: TextOptions = TextOptions(), output: str = "cleaned_text"
) -> DataFrame:
    """Add the cleaned text, ``original_stats``, ``final_stats`` and ``steps``.

    Rows keep their place and nothing is shuffled; works on streams as well.
    """
    steps = text_steps(options)
    names = [*df.columns, output]
    df = df.withColumn("_raw", X.as_text(F.col(column))).withColumn(output, F.col("_raw"))
    for _, f in steps:
        df = df.withColumn(output, f(F.col(output)))
    return df.select(
        *names,
        X.text_stats(F.col("_raw")).alias("original_stats"),
        X.text_stats(F.col(output)).alias("final_stats"),
        F.array(*[F.lit(label) for label, _ in steps]).cast("array<string>").alias("steps"),
    )


def text_report(
    df: DataFrame, column: str = "text", options: TextOptions = TextOptions()
) -> DataFrame:
    """``(step_no, step, rows_changed)`` for every enabled step, from one pass."""
    steps = text_steps(options)
    chain = df.select(X.as_text(F.col(column)).alias("t0"))
    for i, (_, f) in enumerate(steps):
        chain = chain.withColumn(f"t{i + 1}", f(F.col(f"t{i}")))
    counts = chain.agg(
        *[F.count_if(F.col(f"t{i}") != F.col(f"t{i + 1}")).alias(f"n{i}") for i in range(len(steps))]
    )
    rows = [
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(label).alias("step"), F.col(f"n{i}").alias("rows_changed"))
        for i, (label, _) in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*rows)))


def result_json(df: DataFrame, output: str = "cleaned_text") -> Column:
    """``{cleaned_text, stats, steps}`` of a cleaned frame as one JSON string."""
    return F.to_json(
        F.struct(
            F.col(output).alias("cleaned_text"), F.col("final_stats").alias("stats"), F.col("steps")
        )
    )
