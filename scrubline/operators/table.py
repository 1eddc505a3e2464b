"""Header, cell, date and duplicate operators of the table plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import fixed_values as V
from scrubline.functions import text as X
from scrubline.plans.names import quoted as _q


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not among them."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(_q(c)) for c in df.columns])


def strip_headers(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"column names are equal after stripping: {twice}")
    return df.toDF(*names)


def strip_strings(df: DataFrame) -> DataFrame:
    return _replace_columns(df, {c: X.strip(F.col(_q(c))) for c in string_columns(df)})


def lowercase_text(df: DataFrame) -> DataFrame:
    return _replace_columns(df, {c: F.lower(F.col(_q(c))) for c in string_columns(df)})


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def preview(df: DataFrame, order_by: str, n: int = V.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in row-key order (a take-ordered, not a sort)."""
    return df.orderBy(_q(order_by)).limit(n)


def drop_duplicates(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Rows equal in every column become one. Copies are merged before the shuffle,
    so a row that fills the table costs one row per task. With ``row_key`` that
    column is left out of the comparison and its smallest value is kept."""
    if row_key is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != row_key]
    return df.groupBy(*map(_q, others)).agg(F.min(_q(row_key)).alias(row_key)).select(*map(_q, df.columns))
