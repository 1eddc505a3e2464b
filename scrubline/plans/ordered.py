"""Order-dependent work without a single ordered partition.

The order key is cut into buckets of about equal row count. Windows run per
(key, bucket); what must cross a bucket edge travels in a summary table with one
row per (key, bucket). A hot key is spread over all buckets, and the rows are
shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.plans.names import quoted as _q

#: Bounds the summary a key sends to one task. Above ``MAX_BUCKETS * ROWS_PER_BUCKET`` rows
#: (33 billion) buckets grow beyond ``ROWS_PER_BUCKET``; results stay the same.
MAX_BUCKETS = 32_768
ROWS_PER_BUCKET = 1_000_000
SAMPLES_PER_BUCKET = 64
BUCKET, KEY, ORDER = "_bucket", "_key", "_ord"


def order_number(df: DataFrame, name: str) -> Column:
    """The order key as a number that never decreases along the order."""
    kind = df.schema[name].dataType
    c = F.col(_q(name))
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, c)
    raise TypeError(f"order key {name!r} must be a number, date or timestamp, not {kind}")


def literal_array(values: Sequence[int | float], kind: str) -> Column:
    """A constant array of many numbers, sent to the engine as one string."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def order_bounds(
    df: DataFrame, name: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> list[int | float]:
    """Cut points of the order key: ``2**k - 1`` numbers, fewer than ``MAX_BUCKETS``.

    They come from a sample of bounded size, so what the tasks send on is small at
    any scale. The sample only sets where buckets end; every row is processed.
    """
    n = df.count()
    buckets = 1
    while buckets < MAX_BUCKETS and buckets * rows_per_bucket < n:
        buckets *= 2
    if buckets == 1:
        return []
    keys = df.select(order_number(df, name).alias("k"))
    share = buckets * SAMPLES_PER_BUCKET / n
    if share < 1:
        keys = keys.sample(share, seed=17)
    probs = literal_array([i / buckets for i in range(1, buckets)], "double")
    return keys.agg(F.percentile_approx("k", probs, 10 * buckets).alias("q")).first()["q"] or []


def bucket_of(value: Column, bounds: Sequence[int | float]) -> Column:
    """Number of bounds at or below ``value``, by binary search in the engine."""
    if not bounds:
        return F.lit(0)
    kind = "bigint" if isinstance(bounds[0], int) else "double"
    table = literal_array(bounds, kind)
    steps, s = [], (len(bounds) + 1) // 2
    while s:
        steps.append(F.lit(s))
        s //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda pos, step: pos
        + F.when(F.get(table, pos + step - F.lit(1)) <= value, step).otherwise(F.lit(0)),
    )


def bucketed(
    df: DataFrame,
    order_by: str,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    bounds: Sequence[int | float] | None = None,
) -> DataFrame:
    """Add ``_key`` (struct, so null keys join), ``_bucket`` and ``_ord``."""
    if bounds is None:
        bounds = order_bounds(df, order_by, rows_per_bucket)
    return df.select(
        "*",
        F.struct(*([F.col(_q(k)) for k in partition_by] or [F.lit(0).alias("all")])).alias(KEY),
        bucket_of(order_number(df, order_by), bounds).alias(BUCKET),
        order_number(df, order_by).alias(ORDER),
    )


def local_window(*order: Column) -> Window:
    return (
        Window.partitionBy(KEY, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def earlier_buckets() -> Window:
    """Over the summary table: at most ``MAX_BUCKETS`` rows per key."""
    return (
        Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )


def later_buckets() -> Window:
    return (
        Window.partitionBy(KEY)
        .orderBy(F.col(BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def join_summary(rows: DataFrame, summary: DataFrame, single_key: bool) -> DataFrame:
    """Attach the per-(key, bucket) summary. Without partition keys it has at most
    ``MAX_BUCKETS`` rows and is broadcast; otherwise both sides share the window's
    partitioning."""
    summary = F.broadcast(summary) if single_key else summary
    return rows.join(summary, [KEY, BUCKET], "left")


def running_total(
    df: DataFrame,
    value: Column,
    order_by: str,
    name: str,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running sum of ``value``, this row included, in ``order_by`` order per group."""
    b = bucketed(df.withColumn("_v", value), order_by, partition_by, rows_per_bucket)
    summary = (
        b.groupBy(KEY, BUCKET)
        .agg(F.sum("_v").alias("_s"))
        .select(
            KEY, BUCKET,
            F.coalesce(F.sum("_s").over(earlier_buckets()), F.lit(0)).alias("_offset"),
        )
    )
    local = b.withColumn("_run", F.sum("_v").over(local_window(F.col(_q(order_by)))))
    return (
        join_summary(local, summary, not partition_by)
        .withColumn(name, F.col("_offset") + F.col("_run"))
        .drop(KEY, BUCKET, ORDER, "_v", "_run", "_offset")
    )


def with_row_number(
    df: DataFrame,
    order_by: str,
    name: str,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based row number in ``order_by`` order, per ``partition_by`` group."""
    one = F.lit(1).cast("long")
    return running_total(df, one, order_by, name, partition_by, rows_per_bucket)
