"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.plans.materialize import scratch_path


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: computed once, with
    no lineage, and still there when executors are lost. A task holds a row group when it
    writes and when it reads; ``group_rows`` bounds its rows, where these are large."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``; ``make`` must keep no more than a batch in memory."""
    return df.mapInArrow(make, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


#: A key with more than this share of all rows (never more than its inverse of keys) is hot.
HOT_SHARE, HOT_ROWS, HOT_SPLITS = 1 / 256, 200, 64


def hot_keys(counted: DataFrame, keys: list[str], count: str) -> list[tuple]:
    """The keys with a large share of all rows, of a table that counts the rows of each."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    limit = max(int(total * HOT_SHARE), HOT_ROWS)
    return [tuple(r) for r in counted.where(F.col(count) > limit).select(*keys).collect()]


def join_split(
    rows: DataFrame, per_key: DataFrame, keys: list[str], hot: list[tuple], spread: Column, splits: int = HOT_SPLITS,
    how: str = "inner",
) -> DataFrame:
    """``rows`` joined with a table of one row per key; ``hot`` keys, few by definition, are
    split over tasks by ``spread``, a whole number that differs among the rows of a key."""
    if not hot:
        return rows.join(per_key, keys, how)
    one = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    listed = [F.struct(*map(F.lit, k)) if len(keys) > 1 else F.lit(k[0]) for k in hot]
    is_hot = F.coalesce(one.isin(listed), F.lit(False))
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(spread, F.lit(splits)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(per_key.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per ``key``, safe against hot keys.

    ``count`` is the column of ``per_key`` with the rows a key has; it stays in the result.
    Hot keys are split over tasks by a hash of ``spread``."""
    return join_split(rows, per_key, [key], hot_keys(per_key, [key], count), F.xxhash64(spread))
