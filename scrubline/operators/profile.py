"""Profiling: every result is a DataFrame, most are one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil, floor, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import fixed_values as V
from scrubline.operators.table import _q, numeric_columns
from scrubline.plans.quantile import SMALL_ROWS, exact_quantiles


def _rows(pairs: Sequence[tuple[str, dict[str, Column]]]) -> Column:
    """Explode one aggregated row into one row per column of the input."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in cells.items()])
                for name, cells in pairs
            ]
        )
    )


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count")
    )


def shape_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and column list of two versions of a table."""
    sides = [
        table_size(df).select(
            F.lit(name).alias("version"), "row_count", "column_count",
            F.lit(", ".join(df.columns)).alias("columns"),
        )
        for name, df in (("before", before), ("after", after))
    ]
    return sides[0].union(sides[1])


def id_columns(df: DataFrame) -> DataFrame:
    """Columns whose values are all present and all different: ``(position, column)``.

    One pass drops every column with a null, or whose distinct sketch lies far (ten
    standard errors) below the row count. The rest are counted exactly, one column
    per aggregate, so no row is copied per column.
    """
    spark = df.sparkSession
    rsd = 0.02
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(_q(c))).alias(f"c{i}") for i, c in enumerate(df.columns)],
        *[F.approx_count_distinct(F.col(_q(c)), rsd).alias(f"d{i}") for i, c in enumerate(df.columns)],
    ).first()
    likely = [
        i for i in range(len(df.columns))
        if row[f"c{i}"] == row["n"] and row[f"d{i}"] >= (1 - 10 * rsd) * row["n"]
    ]
    counts = [
        df.agg(F.count_distinct(F.col(_q(df.columns[i]))).alias("d")).select(
            F.lit(i + 1).alias("position"), F.lit(df.columns[i]).alias("column"), "d"
        )
        for i in likely
    ]
    if not counts:
        return spark.createDataFrame([], "position int, column string")
    return reduce(DataFrame.union, counts).where(F.col("d") == F.lit(row["n"])).drop("d")


def _null(df: DataFrame, c: str) -> Column:
    col = F.col(_q(c))
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_summary(df: DataFrame) -> DataFrame:
    """``(column, null_count, percentage)`` of the columns that hold nulls."""
    cols = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_null(df, c)).alias(f"k{i}") for i, c in enumerate(cols)]
    )
    cells = [
        (c, {"null_count": F.col(f"k{i}"),
             "percentage": F.bround(F.try_divide(F.col(f"k{i}") * 100.0, F.col("n")), 2)})
        for i, c in enumerate(cols)
    ]
    return counted.select(_rows(cells).alias("r")).select("r.*").where("null_count > 0")


def columns_with_nulls(df: DataFrame) -> list[str]:
    flags = df.agg(*[F.max(_null(df, c)).alias(f"f{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if flags[f"f{i}"]]


def remaining_nulls(df: DataFrame) -> DataFrame:
    per_row = reduce(Column.__add__, [_null(df, c).cast("long") for c in df.columns])
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("remaining_nulls"))


def top_categories(df: DataFrame, column: str, n: int = V.TOP_CATEGORIES) -> DataFrame:
    """The ``n`` most frequent values, the smaller value first among equals."""
    c = F.col(_q(column))
    return (
        df.where(c.isNotNull())
        .groupBy(c.alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "category")
        .limit(n)
    )


def top_share(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value and its share of all rows, nulls included, in percent."""
    counts = df.groupBy(F.col(_q(column)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("v"))))
    return (
        counts.agg(best.alias("b"), F.sum("n").alias("total"))
        .where("b is not null")
        .select(
            F.col("b.v").alias("category"),
            (-F.col("b.m")).alias("n"),
            F.round(-F.col("b.m") * 100.0 / F.col("total"), 1).alias("percent"),
        )
    )


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest among equals; None if all null.

    Counted by group, so no task holds all distinct values. One column is read per
    aggregate and a hot value is merged before the shuffle.
    """
    result = {}
    for c in columns:
        counts = (
            df.where(~_null(df, c)).groupBy(F.col(_q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        )
        result[c] = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")).first()["b"]
        result[c] = result[c]["v"] if result[c] is not None else None
    return result


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode, n)`` with the mode as text."""
    parts = []
    for c in columns:
        counts = (
            df.where(~_null(df, c)).groupBy(F.col(_q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        )
        best = F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")
        parts.append(
            counts.agg(best).where("b is not null").select(
                F.lit(c).alias("column"), F.col("b.v").cast("string").alias("mode"), (-F.col("b.m")).alias("n")
            )
        )
    return reduce(DataFrame.union, parts)


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """``(column, mean, median, std, min, max)`` of the number columns."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    medians = exact_quantiles(df, columns, [0.5], small_rows)
    aggs, cells = [], []
    for i, c in enumerate(columns):
        x = F.nanvl(F.col(_q(c)).cast("double"), F.lit(None))
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        cells.append((c, {
            "mean": F.col(f"a{i}"), "median": F.lit(medians[c][0]).cast("double"),
            "std": F.col(f"s{i}"), "min": F.col(f"l{i}"), "max": F.col(f"h{i}"),
        }))
    return df.agg(*aggs).select(_rows(cells).alias("r")).select("r.*")


def nice_step(lo: float, hi: float, max_bins: int = V.HISTOGRAM_BINS) -> tuple[float, float, float]:
    """Step, start and stop of at most ``max_bins`` bins on round numbers."""
    span = (hi - lo) or abs(lo) or 1.0
    step = 10.0 ** (round(log10(span)) - ceil(log10(max_bins)))
    while ceil(span / step) > max_bins:
        step *= 10
    for divisor in (5, 2):
        if span / (step / divisor) <= max_bins:
            step /= divisor
    return step, floor(lo / step + 1e-9) * step, ceil(hi / step - 1e-9) * step


def histogram(df: DataFrame, column: str, max_bins: int = V.HISTOGRAM_BINS) -> DataFrame:
    """``(bin_start, bin_end, n)`` of the non-empty bins of the finite values; the top end
    belongs to the last bin."""
    number = F.col(_q(column)).cast("double")
    # infinite values belong to no bin
    x = F.when(F.abs(number) < F.lit(float("inf")), number)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin_start double, bin_end double, n long")
    step, start, stop = nice_step(ends["lo"], ends["hi"], max_bins)
    bins = max(1, round((stop - start) / step))
    index = F.least(F.floor((x - F.lit(start)) / F.lit(step)), F.lit(bins - 1)).alias("b")
    return (
        df.where(x.isNotNull())
        .groupBy(index)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            (F.lit(start) + F.col("b") * F.lit(step)).alias("bin_start"),
            (F.lit(start) + (F.col("b") + 1) * F.lit(step)).alias("bin_end"),
            "n",
        )
    )


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(var1, var2, correlation)``, over complete pairs.

    Null where a side is constant. Every batch of rows is one matrix product with itself and
    with the mask of its values, so the plan has one column whatever the number of columns,
    and a task sends six sums for each pair.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("correlation needs at least two number columns")
    values = [F.nanvl(F.col(_q(c)).cast("double"), F.lit(None)) for c in columns]
    # Sums of what lies above a column's least value stay small beside their differences.
    least = df.agg(F.array(*[F.min(v) for v in values]).alias("m")).first()["m"]
    shifts = [x if x is not None and abs(x) < float("inf") else 0.0 for x in least]
    rows = df.select(F.array(*[v - F.lit(s) for v, s in zip(values, shifts)]).alias("x"))
    d = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            held = ~np.isnan(x)
            x, m = np.where(held, x, 0.0), held.astype(np.float64)
            squares = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, squares.T @ m, m.T @ squares, x.T @ x])
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in total]],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = rows.mapInArrow(sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    whole = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    # A spread this small beside its sums is rounding.
    spread = lambda s, ss: F.when(F.expr(f"n * {ss} - {s} * {s} > 1e-13 * n * {ss}"), F.expr(f"sqrt(n * {ss} - {s} * {s})"))
    r = F.when(F.col("i") == F.col("j"), F.when(spread("sx", "sxx").isNotNull(), F.lit(1.0))).otherwise(
        F.expr("n * sxy - sx * sy") / (spread("sx", "sxx") * spread("sy", "syy")))
    r = F.nanvl(r, F.lit(None))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    names = F.array(*map(F.lit, columns))
    cells = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    long = whole.select(F.explode(F.array_distinct(cells)).alias("c"), r.alias("correlation"))
    return long.select(F.get(names, F.col("c.a")).alias("var1"), F.get(names, F.col("c.b")).alias("var2"), "correlation")
