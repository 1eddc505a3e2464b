import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.operators import frames as M
from scrubline.operators import pixels as P
from scrubline.operators import signal as S
from scrubline.plans.clean_signal import SignalOptions, clean_signal
from scrubline.plans.skew import join_per_key


def image_frame(spark, images):
    rows = [
        (i, y, x, c, int(a[y, x, c]))
        for i, a in images.items()
        for y in range(a.shape[0]) for x in range(a.shape[1]) for c in range(a.shape[2])
    ]
    return spark.createDataFrame(rows, "image_id int, y long, x long, channel int, v int")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    return {
        1: rng.integers(0, 256, (13, 17, 3)), 2: rng.integers(100, 140, (9, 30, 3)),
        3: np.full((8, 8, 3), 77), 4: rng.integers(0, 256, (1, 5, 1)),
    }


def test_histograms(spark, images):
    df = image_frame(spark, images)
    got = P.pixel_histogram(df).toPandas()
    norm = P.pixel_histogram_norm(df).toPandas().set_index(["image_id", "channel", "intensity"])["count"]
    for i, a in images.items():
        for c in range(a.shape[2]):
            want = np.bincount(a[:, :, c].ravel(), minlength=256)
            mine = got[(got.image_id == i) & (got.channel == c)].sort_values("intensity")["count"].to_numpy()
            assert (mine == want).all()
            assert np.allclose(norm.loc[i, c].sort_index().to_numpy(), want / np.sqrt((want.astype(float) ** 2).sum()))
    names = df.select(P.channel_name(F.col("channel")).alias("n")).distinct().collect()
    assert {r["n"] for r in names} == {"Red", "Green", "Blue"}


def laplacian_variance(a):
    if a.shape[2] == 3:
        g = np.rint(0.299 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.114 * a[:, :, 2])
    else:
        g = a[:, :, 0].astype(float)
    p = np.pad(g, [(1 if n > 1 else 0,) * 2 for n in g.shape], mode="reflect")
    if g.shape[0] == 1:
        p = np.pad(p, ((1, 1), (0, 0)), mode="edge")
    return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var()


@pytest.mark.parametrize("tile", [3, 8, 128])
def test_blur_score(spark, images, tile):
    rows = {r["image_id"]: r for r in P.blur_score(image_frame(spark, images), tile).collect()}
    for i, a in images.items():
        assert rows[i]["score"] == pytest.approx(laplacian_variance(a), abs=1e-9)
    assert rows[3]["blurry"] and not rows[1]["blurry"]


def numpy_ssim(a, b):
    from numpy.lib.stride_tricks import sliding_window_view as view

    out = []
    for c in range(a.shape[2]):
        x, y = (view(m[:, :, c].astype(float), (7, 7)).reshape(-1, 49) for m in (a, b))
        mx, my = x.mean(1), y.mean(1)
        vx, vy = x.var(1, ddof=1), y.var(1, ddof=1)
        cov = ((x - mx[:, None]) * (y - my[:, None])).sum(1) / 48
        c1, c2 = 2.55**2, 7.65**2
        out.append((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())
    return np.mean(out)


@pytest.mark.parametrize("tile", [4, 128])
def test_quality_metrics(spark, images, tile):
    rng = np.random.default_rng(6)
    twins = {i: np.clip(a + rng.integers(-20, 20, a.shape), 0, 255) for i, a in images.items() if i != 3} | {3: images[3]}
    m = {r["image_id"]: r for r in P.quality_metrics(image_frame(spark, images), image_frame(spark, twins), tile).collect()}
    for i in (1, 2, 3):
        mse = ((images[i] - twins[i]) ** 2).mean()
        assert m[i]["mse"] == pytest.approx(mse)
        assert m[i]["ssim"] == pytest.approx(numpy_ssim(images[i], twins[i]), abs=1e-9)
        assert m[i]["psnr"] == (None if mse == 0 else pytest.approx(10 * np.log10(65025 / mse)))
    assert m[4]["ssim"] is None  # smaller than the window


def test_ssim_shuffles_pixels_once(spark, images):
    df = image_frame(spark, images)
    plan = P.ssim(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 3  # tiles, then two small aggregates
    assert "REPARTITION" in plan


def test_quality_labels(spark):
    def label(s, p, m):
        return tuple(P.quality_summary(spark.createDataFrame([(s, p, m), (None, 1.0, 1.0)], "ssim double, psnr double, mse double")).first())[3:]

    assert label(0.95, 31.0, 20.0) == ("Excellent", "High Quality", "Low Error", "Excellent")
    assert label(0.85, 26.0, 100.0) == ("Good", "Good", "Moderate", "Good")
    assert label(0.5, 20.0, 500.0) == ("Fair", "Fair", "Moderate", "Fair")
    none = spark.createDataFrame([(None, 1.0, 1.0)], "ssim double, psnr double, mse double")
    assert P.quality_summary(none).count() == 0


def test_repair_plan_and_sizes(spark):
    df = spark.createDataFrame([(1, True, 400, 300), (2, True, 900, 300), (3, False, 400, 2000)], "id int, blurry boolean, width int, height int")
    rows = {r["id"]: r for r in P.upscale_size(P.fit_size(P.repair_plan(df))).collect()}
    assert rows[1]["actions"] == ["Auto-Upscaled (Small image)", "Sharpened (Gentle)"] and rows[1]["upscale"] == 1.5
    assert rows[2]["actions"] == ["Sharpened (Gentle)"] and rows[3]["actions"] == ["Clarified (Subtle)"]
    assert (rows[3]["sharpen"], rows[2]["sharpen"]) == (0.2, 0.5)
    assert (rows[1]["fit_width"], rows[1]["fit_height"]) == (400, 300) and (rows[1]["up_width"], rows[1]["up_height"]) == (600, 450)
    assert (rows[3]["fit_width"], rows[3]["fit_height"]) == (205, 1024)
    assert P.repair_plan(df, skip_sharpen=True).where("id = 3").first()["actions"] == []


def test_normalize(spark, images):
    df = image_frame(spark, images)
    for method in ("minmax", "zscore"):
        out = P.pixel_normalize(df, method).toPandas()
        assert len(out) == df.count()
        for (i, c), g in out.groupby(["image_id", "channel"]):
            v = g["v"].to_numpy(float)
            if v.std() == 0:
                assert g["norm"].isna().all()
            elif method == "minmax":
                assert np.allclose(g["norm"], (v - v.min()) / (v.max() - v.min()))
            else:
                assert np.allclose(g["norm"], (v - v.mean()) / v.std())
    with pytest.raises(ValueError):
        P.pixel_normalize(df, "rank")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_join_per_key_with_a_hot_key(spark, broadcast_rows):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    out = join_per_key(rows, stats, ["k"], "n", ["id"], broadcast_rows, hot_share=0.1, splits=8)
    assert out.columns == ["k", "id", "top"]
    got = out.toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(3000))
    want = rows.toPandas()
    assert (got["top"].to_numpy() == want.groupby("k")["id"].transform("max").to_numpy()).all()


def test_frames(spark):
    df = spark.createDataFrame([(i, j, j / 24, i) for i in (1, 2) for j in range(11 * i)], "video_id int, frame_idx long, ts_s double, fps int")
    assert {(r["video_id"], r["frame_idx"]) for r in M.middle_frame(df).collect()} == {(1, 5), (2, 11)}
    assert M.frame_preview(df).groupBy("video_id").count().orderBy("video_id").collect()[0]["count"] == 5
    slots = M.frame_sample(df).where("video_id = 1").orderBy("slot").collect()
    assert [r["frame_idx"] for r in slots] == [0, 2, 4, 5, 7, 8, 10]


def test_video_plan(spark):
    df = spark.createDataFrame([(1, 1920, 1080, 0.0, 100), (2, 600, 800, 25.0, 500)], "id int, width int, height int, fps double, frames int")
    a = {r["id"]: r for r in M.video_plan(df, "720p HD", preview=True).collect()}
    assert (a[1]["target_width"], a[1]["target_fps"], a[1]["duration_s"], a[1]["frames_out"]) == (1280, 30.0, 0.0, 100)
    assert (a[2]["target_width"], a[2]["target_height"], a[2]["duration_s"], a[2]["frames_out"]) == (720, 1280, 20.0, 125)
    shown = ("operation", "suffix", "target_fps", "target_width", "target_height", "frames_out")
    gif = {r["id"]: tuple(r[c] for c in shown) for r in M.video_plan(df, "720p HD", 60, gif=True, compress=True).collect()}
    assert gif == {1: ("gif", ".gif", 15.0, 480, 270, 0), 2: ("gif", ".gif", 15.0, 480, 640, 300)}
    for way in ("remove_audio", "compress"):
        got = {r["id"]: tuple(r[c] for c in shown) for r in M.video_plan(df, "720p HD", 60, preview=True, **{way: True}).collect()}
        assert got == {1: (way, ".mp4", 0.0, 1920, 1080, 100), 2: (way, ".mp4", 25.0, 600, 800, 125)}
    c = M.video_plan(df, fps=60).where("id = 2").first()
    assert tuple(c[x] for x in shown) == ("standard", ".mp4", 60.0, 600, 800, 500)
    assert M.operation() == "standard" and M.operation(remove_audio=True, compress=True) == "remove_audio"


# --- signals ----------------------------------------------------------------


def sound_frame(spark, series):
    rows = [(s, c, i, float(v)) for s, a in series.items() for c, channel in enumerate(a) for i, v in enumerate(channel)]
    return spark.createDataFrame(rows, "series_id int, channel int, idx long, v double")


def tone(spec, rate=1000):
    """Pieces of (milliseconds, amplitude), alternating sign."""
    v = np.concatenate([np.full(ms * rate // 1000, a) for ms, a in spec])
    return v * np.where(np.arange(len(v)) % 2, 1, -1)


def level(v):
    return 20 * np.log10(np.sqrt((v**2).mean())) if (v**2).mean() > 0 else -np.inf


def threshold(v, strict=False):
    return max(min(level(v) - (6 if strict else 10), -15), -50)


def step_trim(v, thresh, step=5):
    at = 0
    while at < len(v) and level(v[at : at + step]) < thresh:
        at += step
    return min(at, len(v))


def range_cut(v, thresh, gap=500, keep=250, seek=10):
    """Gap removal spelled with ranges, one sample per millisecond."""
    n = len(v)
    if n < gap:
        return v
    starts = sorted(set(range(0, n - gap + 1, seek)) | {n - gap})
    silent = [i for i in starts if np.sqrt((v[i : i + gap] ** 2).mean()) <= 10 ** (thresh / 20)]
    ranges = []
    for i in silent:
        if ranges and i <= ranges[-1][1]:
            ranges[-1][1] = i + gap
        else:
            ranges.append([i, i + gap])
    if ranges == [[0, n]]:
        return v
    dropped = np.zeros(n, bool)
    for a, b in ranges:
        dropped[(0 if a == 0 else a + keep) : max(0, n if b == n else b - keep)] = True
    return v[~dropped]


SOUNDS = {
    1: tone([(123, 0.0), (900, 0.5), (1400, 0.0001), (700, 0.4), (499, 0.0), (300, 0.3), (333, 0.0)]),
    2: tone([(900, 0.2), (505, 0.0), (600, 0.2), (2000, 0.0)]),
    3: tone([(1500, 0.0)]),
    4: tone([(800, 0.0), (40, 0.9), (1203, 0.0), (777, 0.1)]),
    5: tone([(300, 0.4)]),
}


@pytest.fixture(scope="module")
def sounds(spark):
    return sound_frame(spark, {k: [v] for k, v in SOUNDS.items()})


def values(df):
    p = df.orderBy("series_id", "idx").toPandas()
    return {k: g["v"].to_numpy() for k, g in p.groupby("series_id")}


def test_levels_and_gain(spark, sounds):
    got = {r["series_id"]: r["dbfs"] for r in S.signal_level(sounds).collect()}
    assert got[3] is None and got[5] == pytest.approx(level(SOUNDS[5]))
    after = values(S.signal_gain(sounds))
    assert (after[3] == 0).all()
    for k in (1, 2, 5):
        assert np.allclose(after[k], np.clip(SOUNDS[k] * 10 ** ((-20 - level(SOUNDS[k])) / 20), -1, 1))


@pytest.mark.parametrize("strict", [False, True])
def test_trim(sounds, strict):
    got = values(S.trim_silence(sounds, 1000, strict=strict))
    for k, v in SOUNDS.items():
        a, b = step_trim(v, threshold(v, strict)), step_trim(v[::-1], threshold(v, strict))
        want = v[a : len(v) - b]
        assert (k not in got and len(want) == 0) or np.allclose(got[k], want), k


@pytest.mark.parametrize("stretch", [64, 1000, 131_072])
def test_gaps(sounds, stretch):
    got = values(S.remove_gaps(sounds, 1000, stretch=stretch))
    shorter = 0
    for k, v in SOUNDS.items():
        want = range_cut(v, threshold(v))
        shorter += len(want) < len(v)
        assert len(got[k]) == len(want) and np.allclose(got[k], want), k
    assert shorter >= 2


def test_renumber_and_durations(sounds):
    kept = S.renumber(S.remove_gaps(sounds, 1000), rows_per_bucket=300)
    p = kept.toPandas()
    for _, g in p.groupby("series_id"):
        assert sorted(g["idx"]) == list(range(len(g)))
    d = {r["series_id"]: r for r in S.duration_compare(sounds, kept.where("series_id <> 5"), 1000).collect()}
    assert d[5]["new_dur"] == 0 and d[3]["orig_dur"] == 1.5 and d[2]["new_dur"] < d[2]["orig_dur"]


@pytest.mark.parametrize("rate,new,stretch", [(1000, 1600, 50), (44100, 16000, 128), (16000, 16000, 64), (8000, 44100, 1000)])
def test_resample(spark, rate, new, stretch):
    v = np.random.default_rng(1).uniform(-1, 1, 441)
    got = values(S.resample(sound_frame(spark, {1: [v]}), rate, new, None, stretch))[1]
    n = -(-len(v) * new // rate)
    assert len(got) == n
    assert np.allclose(got, np.interp(np.arange(n) * rate / new, np.arange(len(v)), v), atol=1e-9)


def test_downmix_thin_props(spark):
    df = sound_frame(spark, {1: [[0.5, 0.25, 1.0], [0.0, 0.75, -1.0]]})
    assert values(S.downmix(df))[1].tolist() == [0.25, 0.5, 0.0]
    series = spark.createDataFrame([(1, 1000, 2)], "series_id int, rate int, width int")
    r = S.signal_props(df, series).first()
    assert (r["duration_s"], r["channels"], r["layout"], r["bits"]) == (0.003, 2, "Stereo", 16)
    long = spark.range(1005).select(F.lit(1).alias("series_id"), F.lit(0).alias("channel"), F.col("id").alias("idx"), F.lit(0.1).alias("v"))
    assert S.thin_series(long, 100).count() == len(range(1005)[::10])


def test_whole_sound_plan(spark, sounds):
    out, report = clean_signal(sounds, 1000, SignalOptions(rate=2000))
    steps = {}
    for r in report.orderBy("series_id", "step_no").collect():
        steps.setdefault(r["series_id"], []).append(r["step"])
    assert all(s[0] == "Normalized to -20dB" and s[-1] == "Format: 2000Hz, 16-bit" for s in steps.values())
    assert "Trimmed Silence" in steps[1] and "Removed internal gaps" in steps[1]
    assert set(steps) == set(SOUNDS) and not any("Mono" in x for s in steps.values() for x in s)
    assert not any(x in ("Trimmed Silence", "Removed internal gaps") for x in steps[5])
    got = out.groupBy("series_id").agg(F.max("idx") + 1, F.count(F.lit(1))).collect()
    assert got and all(r[1] == r[2] for r in got)
    assert dict(out.dtypes)["v"] == "bigint"


def test_threshold_is_fixed_before_trimming(spark):
    v = tone([(27_000, 0.0), (1000, 0.9), (800, 0.093), (1000, 0.9)])
    frame = sound_frame(spark, {1: [v]})
    out, _ = clean_signal(frame, 1000, SignalOptions(convert=False))
    assert out.count() == 2800
    out, _ = clean_signal(frame, 1000, SignalOptions(convert=False, auto_threshold=False, silence_thresh=-15))
    assert out.count() < 2800


@pytest.mark.parametrize("rate", [44_100, 11_025, 1000])
def test_trim_cuts_at_milliseconds(spark, rate):
    v = np.concatenate([np.zeros(2 * rate), np.full(rate, 0.5), np.zeros(2 * rate)])
    got = S.trim_silence(sound_frame(spark, {1: [v]}), rate)
    assert got.count() == rate and got.agg(F.min("idx")).first()[0] == 0


def test_null_series_and_unequal_images(spark):
    df = spark.createDataFrame([(None, 0, 0, 0.5), (1, 0, 0, 0.2)], "series_id int, channel int, idx long, v double")
    assert S.signal_gain(df).count() == 2 and S.thin_series(df).count() == 2
    assert S.signal_props(df, df.select("series_id").limit(0).selectExpr("series_id", "1 as rate", "2 as width")).count() == 2
    a = [(i, y, x, 0, 9) for i in (1, 2) for y in range(8) for x in range(8)]
    b = [(1, y, x, 0, 9) for y in range(8) for x in range(4)]
    names = "image_id int, y int, x int, channel int, v int"
    one, two = spark.createDataFrame(a, names), spark.createDataFrame(b, names)
    got = P.quality_metrics(one, two).collect()
    assert sorted((r["image_id"], r["ssim"], r["mse"]) for r in got) == [(1, None, None), (2, None, None)]
    assert all(r["mse"] == 0 and r["ssim"] == pytest.approx(1) for r in P.quality_metrics(one, one).collect())
