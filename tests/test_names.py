"""Column names with a dot, a space or a back quote."""

import pytest
from pyspark.sql import functions as F

from scrubline.operators import fill, outliers, profile, table
from scrubline.options import FillOptions, TableOptions
from scrubline.plans.clean_table import clean_table


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, float(k % 7) if k % 5 else None, f" t{k % 3} " if k % 4 else None, float(k)) for k in range(40)]
    return spark.createDataFrame(rows, "`k.1` long, `a b` double, `c``d` string, `e.f` double")


@pytest.mark.parametrize("method", ["mean", "median", "mode", "forward", "backward", "interpolate", "zero", "drop"])
def test_fills(odd, method):
    got = fill.fill_nulls(odd, FillOptions(method=method, order_by="k.1"))
    assert got.count() == 40
    if method in ("mode", "forward", "backward", "zero"):
        assert got.where(" or ".join(f"{table._q(c)} is null" for c in got.columns)).count() == 0


def test_table_plan_and_duplicates(odd):
    assert table.drop_duplicates(odd, "k.1").count() == 40
    twice = odd.union(odd.withColumn("k.1", F.col("`k.1`") + 100))
    got, report = clean_table(twice, TableOptions(remove_outliers=True), row_key="k.1")
    assert got.columns == odd.columns and report.count() > 1
    assert table.preview(odd, "k.1").count() == 10


def test_profiles(odd):
    assert profile.numeric_stats(odd).count() >= 3
    assert profile.correlation(odd.select("`a b`", "`e.f`")).count() == 4
    assert profile.histogram(odd, "e.f").count() > 1
    assert profile.null_summary(odd).count() >= 2
    assert profile.top_categories(odd, "c`d").count() == 3
    assert outliers.remove_outliers_iqr(odd, ["e.f"]).count() == 40
    assert outliers.remove_outliers_zscore(odd, ["a b"]).count() == 32


def test_histogram_leaves_infinite_values_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert profile.histogram(df, "v").agg(F.sum("n")).first()[0] == 2


def test_booleans_are_not_numbers(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, True), (4, False)], "k int, flag boolean")
    for method in ("mean", "median"):
        assert [r["flag"] for r in fill.fill_nulls(df, FillOptions(method=method)).orderBy("k").collect()] == [True, None, True, False]
    assert fill.fill_nulls(df, FillOptions()).where("flag").count() == 3
    assert [r["flag"] for r in fill.fill_nulls(df, FillOptions(method="interpolate", order_by="k")).orderBy("k").collect()] == [True, True, True, False]
