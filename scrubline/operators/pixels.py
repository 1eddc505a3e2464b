"""Image measures over a pixel table ``(image_id, y, x, channel, v)``.

``v`` is 0..255; ``channel`` is 0, 1, 2 for red, green, blue (0 alone for gray).
Neighbourhood measures run on overlapping tiles, so one image of any size is
spread over many tasks and the pixels are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.plans import tiles
from scrubline.plans.skew import join_per_key

TILE = 128
PIXEL = ("image_id", "y", "x", "channel")


def _histogram_maps(df: DataFrame) -> DataFrame:
    """One map intensity -> count per image and channel (at most 256 entries)."""
    counts = df.groupBy("image_id", "channel", F.col("v").cast("int").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("image_id", "channel").agg(
        F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m")
    )


def pixel_histogram(df: DataFrame) -> DataFrame:
    """``(image_id, channel, intensity, count)``, 256 rows per image and channel."""
    return _histogram_maps(df).select(
        "image_id", "channel", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("intensity")
    ).select(
        "image_id", "channel", "intensity",
        F.coalesce(F.try_element_at("m", F.col("intensity")), F.lit(0)).alias("count"),
    )


def pixel_histogram_norm(df: DataFrame) -> DataFrame:
    """The histogram scaled to length 1 per image and channel."""
    squares = F.aggregate(
        F.map_values("m"), F.lit(0.0), lambda acc, n: acc + n.cast("double") * n.cast("double")
    )
    return (
        _histogram_maps(df)
        .select(
            "image_id", "channel", "m", F.sqrt(squares).alias("norm"),
            F.explode(F.sequence(F.lit(0), F.lit(255))).alias("intensity"),
        )
        .select(
            "image_id", "channel", "intensity",
            (F.coalesce(F.try_element_at("m", F.col("intensity")), F.lit(0)) / F.col("norm")).alias("count"),
        )
    )


def channel_name(channel: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in V.CHANNEL_NAMES]), channel)


def _tiled(df: DataFrame, halo: int, size: int) -> DataFrame:
    df = tiles.add_tiles(df, "y", size, halo, halo, "_ty")
    return tiles.add_tiles(df, "x", size, halo, halo, "_tx").repartition("image_id", "_ty", "_tx")


def _core(size: int) -> Column:
    return tiles.in_core("y", size, "_ty") & tiles.in_core("x", size, "_tx")


def gray_value() -> Column:
    """8-bit gray of a grouped pixel; a single channel is its own gray."""
    parts = [F.max(F.when(F.col("channel") == k, F.col("v"))) for k in range(3)]
    weighted = sum((w * p for w, p in zip(V.GRAY_WEIGHTS, parts)), F.lit(0.0))
    return F.coalesce(F.round(weighted), parts[0].cast("double"))


def blur_score(df: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, score, blurry)``: variance of the 3x3 Laplacian of gray, edges
    mirrored without repeating the border pixel."""
    gray = _tiled(df, 1, tile).groupBy("image_id", "_ty", "_tx", "y", "x").agg(gray_value().alias("g"))
    row = Window.partitionBy("image_id", "_ty", "_tx", "y").orderBy("x")
    column = Window.partitionBy("image_id", "_ty", "_tx", "x").orderBy("y")

    def pair(w: Window) -> Column:
        before, after = F.lag("g").over(w), F.lead("g").over(w)
        here = F.col("g")  # an image one pixel wide mirrors onto itself
        return F.coalesce(before, after, here) + F.coalesce(after, before, here)

    lap = gray.withColumn("h", pair(row)).withColumn("s", pair(column))
    return (
        lap.where(_core(tile))
        .groupBy("image_id")
        .agg(F.var_pop(F.col("h") + F.col("s") - 4 * F.col("g")).alias("score"))
        .withColumn("blurry", F.col("score") < V.BLUR_LIMIT)
    )


def mse_psnr(original: DataFrame, processed: DataFrame) -> DataFrame:
    """``(image_id, mse, psnr, same_size)`` for every image of either side; PSNR is null for
    equal images. Where a pixel has no partner (other size, or no twin) the metrics are
    null and ``same_size`` is false: nothing is measured on the overlap alone."""
    pairs = original.join(processed.withColumnRenamed("v", "p"), list(PIXEL), "full_outer")
    diff = F.col("v").cast("double") - F.col("p").cast("double")
    per_image = pairs.groupBy("image_id").agg(
        F.avg(diff * diff).alias("all"), F.bool_and(F.col("v").isNotNull() & F.col("p").isNotNull()).alias("same_size"))
    mse = per_image.select("image_id", F.when(F.col("same_size"), F.col("all")).alias("mse"), "same_size")
    return mse.select("image_id", "mse", _psnr(F.col("mse")).alias("psnr"), "same_size")


def _psnr(mse: Column) -> Column:
    return F.when(mse > 0, 10 * F.log10(F.lit(V.PIXEL_RANGE**2) / mse))


def ssim(original: DataFrame, processed: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, ssim)``: 7x7 uniform window, sample covariance, interior pixels,
    mean over pixels and channels. Images smaller than the window give no row, images
    with a pixel that has no partner a null.

    Both versions go through one shuffle, as columns of one tiled frame. Box sums
    are taken along rows, then along columns.
    """
    r = V.SSIM_WINDOW // 2
    one = original.select(*PIXEL, F.col("v").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    two = processed.select(*PIXEL, F.lit(None).cast("double").alias("a"), F.col("v").cast("double").alias("b"))
    cell = ["image_id", "_ty", "_tx", "channel"]
    pixel = (
        _tiled(one.union(two), r, tile)
        .groupBy(*cell, "y", "x")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    terms = {
        "a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"),
        "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b"),
    }
    row = Window.partitionBy(*cell, "y").orderBy("x").rowsBetween(-r, r)
    column = Window.partitionBy(*cell, "x").orderBy("y").rowsBetween(-r, r)
    full = V.SSIM_WINDOW
    sums = pixel.select(
        *cell, "y", "x", F.count(F.lit(1)).over(row).alias("nx"),
        *[F.sum(t).over(row).alias(f"r_{k}") for k, t in terms.items()],
        *[F.count(t).over(row).alias(f"c_{t}") for t in ("a", "b")],
    ).where(F.col("nx") == full)
    sums = sums.select(
        *cell, "y", "x", F.count(F.lit(1)).over(column).alias("ny"),
        *[F.sum(f"r_{k}").over(column).alias(f"s_{k}") for k in terms],
        *[F.sum(f"c_{t}").over(column).alias(f"k_{t}") for t in ("a", "b")],
    ).where(F.col("ny") == full)
    n = full * full
    ma, mb = F.col("s_a") / n, F.col("s_b") / n
    sample = n / (n - 1)
    va = sample * (F.col("s_aa") / n - ma * ma)
    vb = sample * (F.col("s_bb") / n - mb * mb)
    cov = sample * (F.col("s_ab") / n - ma * mb)
    c1, c2 = (V.SSIM_K1 * V.PIXEL_RANGE) ** 2, (V.SSIM_K2 * V.PIXEL_RANGE) ** 2
    s = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    # a window with a missing partner has no complete sums; one such window makes the image null
    whole = F.bool_and((F.col("k_a") == n) & (F.col("k_b") == n))
    per_channel = sums.where(_core(tile)).groupBy("image_id", "channel").agg(F.avg(s).alias("s"), whole.alias("whole"))
    return per_channel.groupBy("image_id").agg(F.when(F.bool_and("whole"), F.avg("s")).alias("ssim"))


def quality_metrics(original: DataFrame, processed: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, ssim, psnr, mse)``; all null where the two sizes differ."""
    return mse_psnr(original, processed).join(ssim(original, processed, tile), "image_id", "left").select(
        "image_id", F.when(F.col("same_size"), F.col("ssim")).alias("ssim"), "psnr", "mse"
    )


def quality_summary(metrics: DataFrame) -> DataFrame:
    """One row of averages over the images with an SSIM, and their labels."""
    a = metrics.where("ssim is not null").agg(
        F.avg("ssim").alias("avg_ssim"), F.avg("psnr").alias("avg_psnr"), F.avg("mse").alias("avg_mse")
    )
    ssim_, psnr, mse = F.col("avg_ssim"), F.col("avg_psnr"), F.col("avg_mse")
    return a.where("avg_ssim is not null").select(
        "*",
        F.when(ssim_ > 0.9, "Excellent").when(ssim_ > 0.8, "Good").otherwise("Fair").alias("ssim_label"),
        F.when(psnr > 30, "High Quality").when(psnr > 25, "Good").otherwise("Fair").alias("psnr_label"),
        F.when(mse < 100, "Low Error").otherwise("Moderate").alias("mse_label"),
        F.when((ssim_ > 0.9) & (psnr > 30), "Excellent").when(ssim_ > 0.8, "Good").otherwise("Fair")
        .alias("overall_label"),
    )


def repair_plan(images: DataFrame, skip_sharpen: bool = False) -> DataFrame:
    """Add ``upscale`` (factor), ``sharpen`` (strength) and ``actions`` to a frame with
    ``width`` and ``blurry``. A decision only; no pixel is changed."""
    small = F.col("blurry") & (F.col("width") < V.SMALL_WIDTH)
    sharpen = F.lit(0.0) if skip_sharpen else F.when(F.col("blurry"), 0.5).otherwise(0.2)
    label = F.when(F.col("blurry"), "Sharpened (Gentle)").otherwise("Clarified (Subtle)")
    return images.withColumns({
        "upscale": F.when(small, V.UPSCALE).otherwise(1.0),
        "sharpen": sharpen,
        "actions": F.array_compact(F.array(
            F.when(small, "Auto-Upscaled (Small image)"), F.lit(None) if skip_sharpen else label
        )),
    })


def fit_size(
    images: DataFrame, max_width: int = V.MAX_WIDTH, max_height: int = V.MAX_HEIGHT
) -> DataFrame:
    """Add ``fit_width`` and ``fit_height``: shrunk to fit with the aspect kept, never
    enlarged. The free side is the whole number whose aspect is nearest."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    shrink = (w > max_width) | (h > max_height)
    wide = w / h >= max_width / max_height

    def nearest(exact: Column, error) -> Column:
        low, high = F.greatest(F.floor(exact), F.lit(1)), F.greatest(F.ceil(exact), F.lit(1))
        return F.when(error(high) < error(low), high).otherwise(low)

    free_h = nearest(max_width * h / w, lambda n: F.abs(w / h - max_width / n))
    free_w = nearest(max_height * w / h, lambda n: F.abs(w / h - n / max_height))
    return images.withColumns({
        "fit_width": F.when(~shrink, F.col("width")).when(wide, F.lit(max_width)).otherwise(free_w).cast("long"),
        "fit_height": F.when(~shrink, F.col("height")).when(wide, free_h).otherwise(F.lit(max_height)).cast("long"),
    })


def upscale_size(images: DataFrame, factor: float = V.UPSCALE) -> DataFrame:
    return images.withColumns({
        "up_width": (F.col("width") * factor).cast("long"), "up_height": (F.col("height") * factor).cast("long"),
    })


def pixel_normalize(df: DataFrame, method: str = "minmax") -> DataFrame:
    """Add ``norm``, scaled per image and channel; null where the channel is flat."""
    v = F.col("v").cast("double")
    if method == "minmax":
        shift, scale = F.min(v), F.max(v) - F.min(v)
    elif method == "zscore":
        shift, scale = F.avg(v), F.stddev_pop(v)
    else:
        raise ValueError("method must be 'minmax' or 'zscore'")
    stats = df.groupBy("image_id", "channel").agg(
        shift.alias("_shift"), scale.alias("_scale"), F.count(F.lit(1)).alias("_n")
    )
    joined = join_per_key(df, stats, ["image_id", "channel"], "_n", ["y", "x"])
    norm = F.when(F.col("_scale") > 0, (v - F.col("_shift")) / F.col("_scale"))
    return joined.withColumn("norm", norm).drop("_shift", "_scale")
