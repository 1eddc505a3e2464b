import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.operators import fill, profile
from scrubline.options import FillOptions
from scrubline.plans import ordered as O


def gaps(n=600):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"k": np.arange(n) * 3 + 7, "g": rng.integers(0, 3, n), "v": rng.normal(0, 10, n).round(3)})
    p["t"] = [f"t{i}" for i in range(n)]
    p.loc[p.index % 5 == 0, "v"] = np.nan
    p.loc[:6, ["v", "t"]] = np.nan
    p.loc[200:380, ["v", "t"]] = np.nan
    p.loc[590:, ["v", "t"]] = np.nan
    p["t"] = p["t"].where(p["t"].notna(), None)
    return p


def frame(spark, p):
    return spark.createDataFrame(p.sample(frac=1, random_state=1), "k long, g long, v double, t string").repartition(5)


def got(df, c, by=("k",)):
    return [None if x is None or x != x else x for x in df.orderBy(*by).toPandas()[c].tolist()]


def want(s):
    return [None if x is None or x != x else x for x in s.tolist()]


@pytest.mark.parametrize("rows_per_bucket", [10**6, 100, 7])
def test_ordered_fills_equal_pandas(spark, rows_per_bucket):
    p, df = gaps(), None
    df = frame(spark, p)
    f = fill.fill_ordered(df, ["v", "t"], "k", rows_per_bucket=rows_per_bucket)
    b = fill.fill_ordered(df, ["v", "t"], "k", "backward", rows_per_bucket=rows_per_bucket)
    for c in ("v", "t"):
        assert got(f, c) == want(p[c].ffill().bfill())
        assert got(b, c) == want(p[c].bfill().ffill())
    i = fill.fill_interpolate(df, ["v", "t"], "k", rows_per_bucket=rows_per_bucket)
    assert got(i, "t") == want(p["t"].ffill())
    line = want(p["v"].interpolate(method="linear"))
    for a, w in zip(got(i, "v"), line):
        assert (a is None and w is None) or a == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("rows_per_bucket", [10**6, 40])
def test_ordered_fills_by_group(spark, rows_per_bucket):
    p = gaps()
    df = frame(spark, p)
    f = fill.fill_ordered(df, ["v"], "k", partition_by=["g"], rows_per_bucket=rows_per_bucket)
    assert got(f, "v") == want(p.groupby("g")["v"].transform(lambda s: s.ffill().bfill()))
    i = fill.fill_interpolate(df, ["v"], "k", ["g"], rows_per_bucket)
    line = want(p.groupby("g")["v"].transform(lambda s: s.interpolate(method="linear")))
    for a, w in zip(got(i, "v"), line):
        assert (a is None and w is None) or a == pytest.approx(w, abs=1e-9)


def test_null_group_keys_and_hot_group(spark):
    rows = [(i, None if i % 3 else 1, None if i % 4 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g long, v double")
    f = fill.fill_ordered(df, ["v"], "k", partition_by=["g"], rows_per_bucket=5)
    p = pd.DataFrame(rows, columns=["k", "g", "v"])
    assert got(f, "v") == want(p.groupby("g", dropna=False)["v"].transform(lambda s: s.ffill().bfill()))


def test_order_by_timestamp_and_date(spark):
    df = spark.range(50).select(
        F.col("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,id)").alias("ts"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
        F.when(F.col("id") % 7 == 3, F.col("id") * 1.0).alias("v"),
    )
    for key in ("ts", "d"):
        f = fill.fill_ordered(df, ["v"], key, rows_per_bucket=6)
        assert got(f, "v", ("id",)) == want(pd.Series([float(i) if i % 7 == 3 else None for i in range(50)]).ffill().bfill())


def test_whole_table_fill_gathers_only_the_summary(spark):
    """The one single-partition exchange lies on the per-bucket aggregate."""
    df = frame(spark, gaps())
    plan = fill.fill_ordered(df, ["v"], "k", rows_per_bucket=50)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1
    assert any("HashAggregate(keys=[[0]" in line and "_bucket" in line for line in lines[single[0] : single[0] + 4])


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, v double")
    for f in (
        fill.fill_mean(df, ["v"]), fill.fill_median(df, ["v"]), fill.fill_mode(df, ["v"]),
        fill.fill_ordered(df, ["v"], "k"), fill.fill_interpolate(df, ["v"], "k"),
    ):
        assert got(f, "v") == [None, None]


def test_scalar_fills(spark):
    df = spark.createDataFrame([(1, 4.0, "a", True), (2, None, None, None), (3, 1.0, "b", False), (4, float("nan"), "b", True)],
                               "k int, v double, s string, b boolean")
    assert got(fill.fill_mean(df, ["v", "s", "b"]), "v") == [4.0, 2.5, 1.0, 2.5]
    assert got(fill.fill_mean(df, ["v", "s", "b"]), "s") == ["a", None, "b", "b"]
    assert got(fill.fill_mean(df, ["b"]), "b") == [True, None, False, True]
    assert got(fill.fill_median(df, ["v"], small_rows=0), "v") == [4.0, 2.5, 1.0, 2.5]
    assert got(fill.fill_mode(df, ["v", "s"]), "v") == [4.0, 1.0, 1.0, 1.0]
    assert got(fill.fill_mode(df, ["v", "s"]), "s") == ["a", "b", "b", "b"]
    assert got(fill.fill_zero(df, ["v", "s"]), "s") == ["a", "0", "b", "b"]
    assert got(fill.fill_custom(df, ["v"], "7"), "v") == [4.0, 7.0, 1.0, 7.0]
    assert got(fill.fill_custom(df, ["s"], ""), "s") == ["a", "", "b", "b"]


def test_custom_value_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 4), (2, None)], "k int, v int")
    with pytest.raises(ValueError):
        fill.fill_custom(df, ["v"], "many")
    assert got(fill.fill_custom(df, ["v"], "many", widen=True), "v") == ["4", "many"]


def test_zero_leaves_timestamps(spark):
    df = spark.createDataFrame([(1, None)], "k int, d timestamp")
    assert fill.fill_zero(df, ["d"]).first()["d"] is None


@pytest.mark.parametrize("method", ["mean", "median", "mode", "forward", "backward", "interpolate", "zero", "custom", "drop"])
def test_dispatcher_never_adds_nulls(spark, method):
    df = frame(spark, gaps(60))
    out = fill.fill_nulls(df, FillOptions(method=method, custom_value="1", order_by="k"))
    assert out.count() == 60
    before, after = profile.remaining_nulls(df).first()[0], profile.remaining_nulls(out).first()[0]
    assert after < before
    if method == "drop":
        assert out.columns == ["k", "g"]


def test_dispatcher_per_column(spark):
    df = frame(spark, gaps(60))
    out = fill.fill_nulls(df, FillOptions(per_column={"v": "custom"}, custom={"v": "0.5"}))
    assert set(got(out, "v")[:7]) == {0.5}
    assert profile.remaining_nulls(out).first()[0] == 0
    with pytest.raises(ValueError):
        fill.fill_nulls(df, FillOptions(method="forward"))
    with pytest.raises(ValueError):
        FillOptions(method="guess")


@pytest.mark.parametrize("bounds", [[], [5], [1, 5, 9], [0.5, 0.5, 2.5], list(range(0, 310, 10))])
def test_bucket_of(spark, bounds):
    df = spark.createDataFrame([(float(x),) for x in range(-3, 320, 2)] + [(None,)], "x double")
    out = df.select("x", O.bucket_of(F.col("x"), bounds).alias("b")).collect()
    for r in out:
        assert r["b"] == (0 if r["x"] is None else sum(b <= r["x"] for b in bounds))


def test_row_numbers(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("k"), (F.col("id") % 2).alias("g"))
    flat = O.with_row_number(df, "k", "n", rows_per_bucket=20).collect()
    assert all(r["n"] == r["k"] + 1 for r in flat)
    by = O.with_row_number(df, "k", "n", ["g"], 20).toPandas()
    assert (by["n"] == by.groupby("g")["k"].rank()).all()
