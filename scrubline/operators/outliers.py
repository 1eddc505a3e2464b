"""Outlier filters.

Columns are filtered one after the other: the statistics of a column use only
the rows the earlier columns left. Each step is one aggregate over a scan with
the earlier limits pushed down as constants; no rows are shuffled or cached. A
null in a filtered column drops the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.operators.table import _q, numeric_columns
from scrubline.plans.quantile import SMALL_ROWS, exact_quantiles


def remove_outliers_zscore(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = V.Z_LIMIT
) -> DataFrame:
    """Keep rows with ``|x - mean| / std < threshold`` (sample deviation)."""
    for name in columns if columns is not None else numeric_columns(df):
        x = F.nanvl(F.col(_q(name)).cast("double"), F.lit(None))
        s = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first()
        if s["std"] is not None and s["std"] > 0:
            df = df.where(F.abs((x - F.lit(s["mean"])) / F.lit(s["std"])) < F.lit(threshold))
    return df


def remove_outliers_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges of the quartiles, ends included."""
    for name in columns if columns is not None else numeric_columns(df):
        q1, q3 = exact_quantiles(df.select(F.col(_q(name)).alias("x")), ["x"], [0.25, 0.75], small_rows)["x"]
        if q1 is not None and q3 - q1 > 0:
            reach = V.IQR_REACH * (q3 - q1)
            x = F.nanvl(F.col(_q(name)).cast("double"), F.lit(None))
            df = df.where(x.between(F.lit(q1 - reach), F.lit(q3 + reach)))
    return df
