import numpy as np
import pytest

from scrubline.plans import quantile
from scrubline.plans.quantile import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 1.0]


def data(kind, n=2000):
    rng = np.random.default_rng(11)
    if kind == "hot":  # a third of the rows share one value
        return np.concatenate([np.full(n // 3, 7.0), rng.normal(7, 3, n - n // 3)])
    if kind == "few":
        return rng.integers(0, 3, n).astype(float)
    return rng.lognormal(0, 3, n)


@pytest.mark.parametrize("kind", ["hot", "few", "tail"])
@pytest.mark.parametrize("small_rows", [10**6, 40])
def test_equals_numpy(spark, kind, small_rows):
    v = data(kind)
    rows = [(float(x), None if i % 5 else float(-x)) for i, x in enumerate(v)] + [(float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = exact_quantiles(df, ["a", "b"], PROBS, small_rows)
    assert got["a"] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12)
    assert got["b"] == pytest.approx(np.quantile(-v[::5], PROBS).tolist(), rel=1e-12)


def test_a_sample_that_misses_is_noticed(spark, monkeypatch):
    v = data("tail", 2000)
    df = spark.createDataFrame([(float(x),) for x in v], "a double")
    monkeypatch.setattr(quantile, "_sample", lambda df, n: df.where("a > 5").limit(20))
    assert exact_quantiles(df, ["a"], [0.3], 10)["a"][0] == pytest.approx(np.quantile(v, 0.3), rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5], 0) == {"a": [None], "b": [1.0]}


def test_both_paths_agree_to_the_last_bit(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in rng.normal(0, 1e3, (997, 2))], "`a.b` double, `c d` double")
    probs = [k / 24 for k in range(25)]
    assert exact_quantiles(df, ["a.b", "c d"], probs, 10) == exact_quantiles(df, ["a.b", "c d"], probs, 10_000)
