"""Null filling.

Scalar fills of all columns share one aggregate and one projection. Ordered
fills run on order buckets (see ``plans.ordered``), so neither a whole table nor
a hot partition key passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.profile import _null, columns_with_nulls, mode_values
from scrubline.operators.table import _q, _replace_columns
from scrubline.options import FillOptions
from scrubline.plans import ordered as O
from scrubline.plans.quantile import SMALL_ROWS, exact_quantiles


def is_numeric(df: DataFrame, c: str) -> bool:
    """Numbers. A boolean column with nulls holds objects, not numbers: its default is the
    mode, and mean, median and lines between values leave it alone."""
    return isinstance(df.schema[c].dataType, T.NumericType)


def _clean(df: DataFrame, c: str) -> Column:
    """The column with NaN read as null."""
    col = F.col(_q(c))
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(col, F.lit(None))
    return col


def _number(df: DataFrame, c: str) -> Column:
    return _clean(df, c).cast("double")


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number columns become double; other columns stay as they are."""
    cols = [c for c in columns if is_numeric(df, c)]
    if not cols:
        return df
    row = df.agg(*[F.avg(_number(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return _replace_columns(
        df, {c: F.coalesce(_number(df, c), F.lit(row[f"m{i}"])) for i, c in enumerate(cols)}
    )


def fill_median(df: DataFrame, columns: Sequence[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    cols = [c for c in columns if is_numeric(df, c)]
    if not cols:
        return df
    numbers = df.select(*[_number(df, c).alias(c) for c in cols])
    medians = exact_quantiles(numbers, cols, [0.5], small_rows)
    return _replace_columns(
        df, {c: F.coalesce(_number(df, c), F.lit(medians[c][0]).cast("double")) for c in cols}
    )


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = mode_values(df, columns)
    return _replace_columns(
        df,
        {
            c: F.coalesce(_clean(df, c), F.lit(modes[c]).cast(df.schema[c].dataType))
            for c in columns
            if modes[c] is not None
        },
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0 for numbers, ``'0'`` for text, false for booleans; dates are left alone."""
    kept = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return _replace_columns(
        df,
        {
            c: F.coalesce(_clean(df, c), F.lit(0).cast(df.schema[c].dataType))
            for c in columns
            if not isinstance(df.schema[c].dataType, kept)
        },
    )


def fill_custom(
    df: DataFrame, columns: Sequence[str], value: str, widen: bool = False
) -> DataFrame:
    """Fill with a value given as text. One that does not fit the column type
    raises, or with ``widen`` turns the column into text."""
    new = {}
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType for c in columns}
    if not columns:
        return df
    fits = spark.range(1).select(
        *[F.lit(value).try_cast(k).isNotNull().alias(f"f{i}") for i, k in enumerate(kinds.values())]
    ).first()
    for i, (c, kind) in enumerate(kinds.items()):
        if fits[f"f{i}"]:
            new[c] = F.coalesce(_clean(df, c), F.lit(value).cast(kind))
        elif widen:
            new[c] = F.coalesce(_clean(df, c).cast("string"), F.lit(value))
        else:
            raise ValueError(f"{value!r} does not fit column {c!r} of type {kind.simpleString()}")
    return _replace_columns(df, new)


# --- ordered fills ----------------------------------------------------------


def _edge(c: Column, pick) -> Column:
    """First or last non-null value of a bucket, by the order key."""
    return pick(c, F.when(c.isNotNull(), F.col(O.ORDER)))


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order_by: str,
    direction: str = "forward",
    both_ways: bool = True,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = O.ROWS_PER_BUCKET,
    bounds: Sequence[int | float] | None = None,
) -> DataFrame:
    """Take the previous (or next) non-null value in ``order_by`` order; with
    ``both_ways`` the rows before the first (or after the last) take the nearest.
    ``order_by`` must be different for every row of a group. ``bounds`` are cut points
    already known for that key (``plans.ordered.order_bounds``)."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    columns = list(columns)
    sides = [direction]
    if both_ways:
        sides.append("backward" if direction == "forward" else "forward")
    b = O.bucketed(df, order_by, partition_by, rows_per_bucket, bounds)
    edges, carries, local = [], [], {}
    for i, c in enumerate(columns):
        v = _clean(df, c)
        for side in sides:
            forward = side == "forward"
            edges.append(_edge(v, F.max_by if forward else F.min_by).alias(f"_{side}{i}"))
            w = O.earlier_buckets() if forward else O.later_buckets()
            carries.append(F.last(f"_{side}{i}", ignorenulls=True).over(w).alias(f"_{side}{i}"))
            # a backward look is a running window over the reversed order
            order = F.col(_q(order_by)) if forward else F.col(_q(order_by)).desc()
            local[f"_l{side}{i}"] = F.last(v, ignorenulls=True).over(O.local_window(order))
    summary = b.groupBy(O.KEY, O.BUCKET).agg(*edges).select(O.KEY, O.BUCKET, *carries)
    joined = O.join_summary(b.withColumns(local), summary, not partition_by)
    new = {
        c: F.coalesce(
            *[F.coalesce(F.col(f"_l{side}{i}"), F.col(f"_{side}{i}")) for side in sides]
        )
        for i, c in enumerate(columns)
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(_q(c)) for c in df.columns])


def fill_interpolate(
    df: DataFrame,
    columns: Sequence[str],
    order_by: str,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = O.ROWS_PER_BUCKET,
    bounds: Sequence[int | float] | None = None,
) -> DataFrame:
    """Straight line by row position between the neighbours. Leading nulls stay,
    trailing ones take the last value. Text columns are filled forward only."""
    numeric = [c for c in columns if is_numeric(df, c)]
    text = [c for c in columns if c not in numeric]
    if bounds is None:
        bounds = O.order_bounds(df, order_by, rows_per_bucket)
    if text:
        df = fill_ordered(df, text, order_by, "forward", False, partition_by, bounds=bounds)
    if not numeric:
        return df

    b = O.bucketed(df, order_by, partition_by, rows_per_bucket, bounds)
    rn = F.row_number().over(Window.partitionBy(O.KEY, O.BUCKET).orderBy(_q(order_by)))
    b = b.withColumn("_rn", rn)
    up, down = O.local_window(F.col(_q(order_by))), O.local_window(F.col(_q(order_by)).desc())
    near = {}
    for i, c in enumerate(numeric):
        v = _number(df, c)
        point = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("_rn").cast("long").alias("p")))
        near[f"_prev{i}"] = F.last(point, ignorenulls=True).over(up)
        near[f"_next{i}"] = F.last(point, ignorenulls=True).over(down)

    # per bucket: its row count and its outermost points; then positions are made global
    ends = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(numeric):
        v = _number(df, c)
        at = F.when(v.isNotNull(), F.col("_rn"))
        ends += [
            F.max_by(v, at).alias(f"_lastv{i}"), F.max(at).alias(f"_lastp{i}"),
            F.min_by(v, at).alias(f"_firstv{i}"), F.min(at).alias(f"_firstp{i}"),
        ]
    summary = b.groupBy(O.KEY, O.BUCKET).agg(*ends)
    summary = summary.withColumn("_off", F.coalesce(F.sum("_n").over(O.earlier_buckets()), F.lit(0)))
    carries = []
    for i in range(len(numeric)):
        for side, w in (("last", O.earlier_buckets()), ("first", O.later_buckets())):
            point = F.struct(
                F.col(f"_{side}v{i}").alias("v"), (F.col("_off") + F.col(f"_{side}p{i}")).alias("p")
            )
            carries.append(
                F.last(F.when(F.col(f"_{side}p{i}").isNotNull(), point), ignorenulls=True).over(w).alias(f"_{side}{i}")
            )
    summary = summary.select(O.KEY, O.BUCKET, "_off", *carries)
    joined = O.join_summary(b.withColumns(near), summary, not partition_by)

    new = {}
    for i, c in enumerate(numeric):
        here = F.col("_rn") + F.col("_off")

        def shifted(name: str) -> Column:
            point = F.col(name)
            return F.when(
                point.isNotNull(), F.struct(point["v"].alias("v"), (point["p"] + F.col("_off")).alias("p"))
            )

        prev = F.coalesce(shifted(f"_prev{i}"), F.col(f"_last{i}"))
        after = F.coalesce(shifted(f"_next{i}"), F.col(f"_first{i}"))
        line = prev["v"] + (after["v"] - prev["v"]) * (here - prev["p"]) / (after["p"] - prev["p"])
        new[c] = (
            F.when(_number(df, c).isNotNull(), _number(df, c))
            .when(prev.isNull(), F.lit(None))
            .when(after.isNull(), prev["v"])
            .otherwise(line)
        )
    return joined.select(*[new[c].alias(c) if c in new else F.col(_q(c)) for c in df.columns])


# --- dispatcher -------------------------------------------------------------


def fill_nulls(df: DataFrame, options: FillOptions) -> DataFrame:
    """Fill every column that holds nulls, by one method or column by column."""
    key = options.order_by
    with_nulls = [c for c in columns_with_nulls(df) if c != key]
    groups: dict[str, list[str]] = {}
    for c in with_nulls:
        default = "mean" if is_numeric(df, c) else "mode"
        groups.setdefault(options.method or options.per_column.get(c, default), []).append(c)
    if key is None and set(groups) & {"forward", "backward", "interpolate"}:
        raise ValueError("ordered filling needs order_by")
    bounds = O.order_bounds(df, key) if set(groups) & {"forward", "backward", "interpolate"} else None
    for method, cols in groups.items():
        if method == "drop":
            df = df.drop(*cols)
        elif method == "mean":
            df = fill_mean(df, cols)
        elif method == "median":
            df = fill_median(df, cols)
        elif method == "mode":
            df = fill_mode(df, cols)
        elif method == "zero":
            df = fill_zero(df, cols)
        elif method == "custom":
            for c in cols:
                value = options.custom.get(c, options.custom_value)
                if value is not None:
                    df = fill_custom(df, [c], value, options.widen)
        elif method == "interpolate":
            df = fill_interpolate(df, cols, key, options.partition_by, bounds=bounds)
        else:
            df = fill_ordered(df, cols, key, method, True, options.partition_by, bounds=bounds)
    return df
