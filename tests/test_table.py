import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.operators import dates, outliers, profile
from scrubline.operators import table as T
from scrubline.options import TableOptions
from scrubline.plans.clean_table import clean_table


def test_strip_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, `b\t` int")
    assert T.strip_headers(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        T.strip_headers(spark.createDataFrame([(1, 2)], "` a` int, `a ` int"))


def test_strip_and_lower_leave_other_types(spark):
    df = spark.createDataFrame([(1, " A ", True), (2, None, None)], "i int, `s.x` string, b boolean")
    assert [tuple(r) for r in T.lowercase_text(T.strip_strings(df)).orderBy("i").collect()] == [(1, "a", True), (2, None, None)]


DATES = [
    ["2024-01-05", "2024-02-07", None], ["13/02/2024", "03/02/2024"], ["03/02/2024", "13/02/2024", "14/02/2024"],
    ["03/02/2024", "04/02/2024", "13/02/2024"], ["12", "13"], ["0.04", "1.5"], ["20240101", "20240202"], ["a", "b"],
    ["Jan 5, 2024", "Feb 3, 2024"], ["5 January 2024", "6 March 2024"], ["05-Jan-2024", "06-Feb-2024"],
    ["2024-01-01 10:00", "2024-01-02 11:30"], ["2024-01-01T10:00:00", "2024-01-02T11:30:10"], ["1/2/2024", "3/4/2024"],
    ["2024/01/02", "2024/01/05"], ["13.02.2024", "03.02.2024"], ["2024-01-01", None, None], ["2024-01-01", None],
    ["hello", "2024-01-01", "2024-01-02"], ["x", "y", "2024-01-01"], ["2024-01-15", "2024-01-16"],
    ["2024-01-05 10:00:00.123", "2024-01-06 10:00:01.5"], ["2024/01/15", "2024/01/05"], ["2024-01", "2024-02"],
    ["01/05/24", "13/05/24", "31/12/68"], ["01-05-24", "1-6-75"], ["01.05.24 10:20"], ["24/01/05"], ["45/01/05"], ["05-Jan-24", "6 Feb 99"],
    ["01/05/2024 10:20 AM", "03/04/2024 01:05 PM"], ["01/05/2024 10:20:30 PM", "1/5/2024 1:20 pm"], ["2024-01-05 10:20 AM"],
    ["Jan 5, 2024 10:20 PM"], ["01/05/2024 10 AM"], ["01/05/2024 10:20AM"], ["01-05-2024 10:20 PM"], ["05.01.2024 12:20 AM"],
    ["Jan 2024", "March 2023"], ["January 2024"], ["01/2024", "12-2023"], ["2024/01"], ["Jan-2024"], ["2024 Jan"], ["2024-Jan"],
    ["05-01-2024 10:20", "06-01-2024 11:20"], ["05-01-2024 10:20:30"], ["05.01.2024 10:20"], ["05.01.2024 10:20:30"], ["5.1.2024 1:02"],
    ["05/01/2024 10:20:30.123"], ["2024.01.05"], ["2024.01.15 10:20"], ["2024/01/05 10:20:30"], ["5 Jan 2024 10:20"],
    ["Jan 5, 2024 10:20:30"], ["5-Jan-2024 10:20:30"], ["Friday, January 5, 2024"], ["Fri Jan 5 2024"],
    ["Fri, 05 Jan 2024 10:20:30 GMT"], ["20240105T102030"], ["20240105 102030"], ["05Jan2024"], ["May 2024", "may 5, 2024", "5 May 2024"],
    ["Jan 2024", "01/05/24", "2024-02-03", "3 Apr 2024", "05.06.2024 10:11", "word"], ["AB-123", "CD-456"], ["1704450000"], ["2024-005"],
]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("order", ["auto", "global", "us"])
def test_date_vote_equals_pandas(spark, order):
    p = pd.DataFrame({f"c{i}": (v * 6)[:6] for i, v in enumerate(DATES)}, dtype=object)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(p.values.tolist())],
                               "k int, " + ", ".join(f"{c} string" for c in p.columns))
    out, found = dates.convert_dates(df, "k", date_order=order)
    got = out.orderBy("k").collect()
    for c in p.columns:
        # a year and a month alone are read by the fallback parser where the order is day first
        parsed = pd.to_datetime(p[c], errors="coerce", dayfirst=order == "global")
        is_date = parsed.notna().sum() / len(p) > 0.5
        assert (c in found) == is_date, (c, p[c].tolist())
        want = [None if pd.isna(x) else x.to_pydatetime() for x in parsed] if is_date else p[c].tolist()
        assert [r[c] for r in got] == want, c


ZONED = [
    ["2024-01-05T10:20:30Z", "2024-01-06T00:00:00Z"], ["2024-01-05 10:20:30+02:00", "2024-01-05 11:20:30+02:00"],
    ["2024-01-05T10:20:30.123+0200"], ["2024-01-05T10:20+05:30"], ["2024-01-05 10:20:30 +02:00"], ["2024-01-05 10:20:30 UTC"],
]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("order", ["auto", "global"])
def test_dates_with_zones_equal_pandas(spark, order):
    p = pd.DataFrame({f"c{i}": (v * 2)[:2] for i, v in enumerate(ZONED)}, dtype=object)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(p.values.tolist())], "k int, " + ", ".join(f"{c} string" for c in p.columns))
    out, found = dates.convert_dates(df, "k", date_order=order)
    assert found == list(p.columns) and {t for c, t in out.dtypes if c != "k"} == {"timestamp"}
    got = out.orderBy("k").select(*[F.unix_micros(c).alias(c) for c in p.columns]).collect()
    for c in p.columns:
        want = pd.to_datetime(p[c], errors="coerce", dayfirst=order == "global")
        assert [r[c] for r in got] == [x.value // 1000 for x in want], c


def test_text_columns_are_not_parsed_for_dates(spark):
    """Only columns that look like dates cost more than the first aggregate."""
    rows = [(k, f"name {k}", f"{k % 28 + 1}/02/2024", None if k else "x") for k in range(50)]
    df = spark.createDataFrame(rows, "k int, s string, d string, n string")
    assert list(dates.detect_dates(df, "k", date_order="global")) == ["d"]
    assert dates.detect_dates(df.select("k", "s"), "k") == {}


def test_signatures_join_what_the_same_layouts_read(spark):
    texts = ["5 Jan 2024", "7 dec 1999", "12 December 2024", "Friday, May 3, 2024", "a 5 Jan 2024", "1:02 pm", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(dates.signature(F.col("t"))).collect()]
    assert got == ["9 jan 9999", "9 dec 9999", "99 dec~ 9999", "fri~, may 9, 9999", None, "9:99 pm", None]


def test_duplicates(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1.0), (2, "b", 1.0)], "k int, s string, v double")
    assert T.drop_duplicates(df).count() == 3
    assert sorted(r["k"] for r in T.drop_duplicates(df, "k").collect()) == [1, 2]


def messy_numbers():
    rng = np.random.default_rng(7)
    p = pd.DataFrame({"a": rng.exponential(10, 800), "b": rng.normal(0, 1, 800), "c": 5.0, "d": rng.integers(0, 50, 800)})
    p.loc[::13, "a"] = np.nan
    p.loc[5, "b"] = 60
    p["flag"] = p["d"] > 25
    p["k"] = range(800)
    return p


def pandas_filter(p, columns, method, limit):
    for c in columns:
        if method == "z":
            std = p[c].std()
            if std > 0:
                p = p[((p[c] - p[c].mean()) / std).abs() < limit]
        else:
            q1, q3 = p[c].quantile(0.25), p[c].quantile(0.75)
            if q3 - q1 > 0:
                p = p[(p[c] >= q1 - 1.5 * (q3 - q1)) & (p[c] <= q3 + 1.5 * (q3 - q1))]
    return sorted(p["k"])


@pytest.mark.parametrize("method,limit,small", [("z", 2.0, 0), ("z", 3.0, 0), ("iqr", 0, 10**6), ("iqr", 0, 20)])
def test_outliers_equal_pandas(spark, method, limit, small):
    p = messy_numbers()
    df = spark.createDataFrame(p)
    assert T.numeric_columns(df) == ["a", "b", "c", "d", "k"]
    columns = ["a", "b", "c", "d"]
    if method == "z":
        out = outliers.remove_outliers_zscore(df, columns, limit)
    else:
        out = outliers.remove_outliers_iqr(df, columns, small)
    want = pandas_filter(p, columns, method, limit)
    assert sorted(r["k"] for r in out.select("k").collect()) == want and len(want) < 800


def test_one_row_and_all_null_columns_are_kept(spark):
    one = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert outliers.remove_outliers_zscore(one).count() == 1
    assert outliers.remove_outliers_iqr(one).count() == 1


def test_clean_table_plan(spark):
    rows = [(1, " X ", "01/02/2024", 1.0), (2, " X ", "01/02/2024", 1.0), (3, "y", "13/02/2024", 2.0)]
    df = spark.createDataFrame(rows, "k int, ` s` string, d string, v double")
    out, report = clean_table(df, TableOptions(lowercase_text=True, date_order="global", remove_outliers=True), "k")
    assert out.columns == ["k", "s", "d", "v"]
    assert sorted((r["k"], r["s"], r["d"].day, r["d"].month) for r in out.collect()) == [(1, "x", 1, 2), (3, "y", 13, 2)]
    steps = [tuple(r) for r in report.orderBy("step_no").collect()]
    assert [s[2] for s in steps] == [None, None, None, None, 1, 0]
    assert steps[4][1] == "✓ Removed 1 duplicate row(s)" and steps[5][1] == "✓ No outliers found using Z_SCORE"


def test_clean_table_without_key_or_counts(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 1)], "d string, v int")
    out, report = clean_table(df, TableOptions(remove_outliers=True, outlier_method="iqr"), with_counts=False)
    assert out.count() == 1 and dict(out.dtypes)["d"] == "timestamp_ntz"
    assert report.count() == 4


def test_options_are_checked():
    with pytest.raises(ValueError):
        TableOptions(outlier_method="mad")
    with pytest.raises(ValueError):
        TableOptions(date_order="iso")


def test_profile_against_pandas(spark):
    p = messy_numbers()
    df = spark.createDataFrame(p)
    cols = ["a", "b", "c", "d"]
    for small in (10**6, 10):
        stats = {r["column"]: r for r in profile.numeric_stats(df, cols, small).collect()}
        for c in cols:
            assert stats[c]["median"] == pytest.approx(p[c].median(), rel=1e-12)
            assert stats[c]["std"] == pytest.approx(p[c].std()) and stats[c]["mean"] == pytest.approx(p[c].mean())
    corr = {(r["var1"], r["var2"]): r["correlation"] for r in profile.correlation(df, cols).collect()}
    want = p[cols].corr()
    for x in cols:
        for y in cols:
            if np.isnan(want.loc[x, y]):
                assert corr[x, y] is None
            else:
                assert corr[x, y] == pytest.approx(want.loc[x, y])
    nulls = {r["column"]: (r["null_count"], r["percentage"]) for r in profile.null_summary(df).collect()}
    assert nulls == {"a": (62, 7.75)} and profile.columns_with_nulls(df) == ["a"]
    assert profile.remaining_nulls(df).first()[0] == 62
    assert [r["column"] for r in profile.id_columns(df).orderBy("position").collect()] == ["b", "k"]


def test_mode_and_top(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 3, 1, 2, None)], "v int")
    assert profile.mode_values(df, ["v"]) == {"v": 1}
    assert tuple(profile.top_share(df, "v").first()) == (1, 2, 33.3)
    assert [tuple(r) for r in profile.top_categories(df, "v", 2).collect()] == [(1, 2), (3, 2)]
    assert profile.mode_values(spark.createDataFrame([(None,)], "v int"), ["v"]) == {"v": None}
    assert profile.top_share(spark.createDataFrame([(None,)], "v int"), "v").count() == 0


@pytest.mark.parametrize(
    "lo,hi,step", [(0.0, 100.0, 5.0), (0.0, 1.0, 0.05), (3.0, 997.0, 50.0), (0.0, 27.0, 1.0), (5.0, 5.0, 0.2)]
)
def test_nice_step(lo, hi, step):
    got, start, stop = profile.nice_step(lo, hi)
    assert got == pytest.approx(step) and start <= lo and stop >= hi - 1e-9


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    bins = profile.histogram(df, "v").collect()
    assert sum(b["n"] for b in bins) == 101 and len(bins) == 20


def test_correlation_of_many_columns_is_one_small_plan(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 100)) @ rng.normal(0, 1, (100, 100)) + rng.normal(0, 1e6, 100)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.5
    x[:250, 8], x[250:, 9] = np.nan, np.nan
    p = pd.DataFrame(x, columns=[f"c{k}" for k in range(100)])
    df = spark.createDataFrame(p).repartition(4)
    got = profile.correlation(df)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    want = p.corr()
    for r in got.collect():
        w = want.loc[r["var1"], r["var2"]]
        assert (r["correlation"] is None) == bool(np.isnan(w)) and (np.isnan(w) or abs(r["correlation"] - w) < 1e-6), r


def test_clean_table_reads_the_columns_it_filters(spark, tmp_path):
    rows = [(k, f"n{k}", float(k % 9), float(k % 5), "x") for k in range(300)] + [(0, "n0", 0.0, 0.0, "x")] * 3
    df = spark.createDataFrame(rows, "k int, s string, v double, w double, t string")
    cleaned, _ = clean_table(df, TableOptions(convert_dates=False, remove_outliers=True), with_counts=False)
    plan = cleaned.select("v")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan
    read = plan[plan.rindex("ReadSchema:"):]
    assert "s:string" not in read and "t:string" not in read
