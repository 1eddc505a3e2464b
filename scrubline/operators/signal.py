"""Sound measures and edits over a sample table ``(series_id, channel, idx, v)``.

``v`` lies in -1..1, ``idx`` runs 0, 1, 2, ... per series and ``rate`` is samples
per second. Anything that looks at neighbours runs on overlapping stretches of a
series, and per-series results come back by a skew-safe join, so one series may
hold most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.plans import ordered as O
from scrubline.plans import tiles
from scrubline.plans.materialize import materialize
from scrubline.plans.skew import join_per_key

STRETCH = 131_072
SPREAD = ("idx", "channel")


def dbfs(mean_square: Column, max_amp: float = 1.0) -> Column:
    """Level in dB of full scale; null for silence."""
    return F.when(mean_square > 0, 20 * F.log10(F.sqrt(mean_square) / max_amp))


def _mean_square() -> Column:
    return F.avg(F.col("v") * F.col("v"))


def signal_level(df: DataFrame, max_amp: float = 1.0) -> DataFrame:
    """``(series_id, dbfs)``."""
    return df.groupBy("series_id").agg(dbfs(_mean_square(), max_amp).alias("dbfs"))


def signal_gain(df: DataFrame, target: float = V.TARGET_DBFS, max_amp: float = 1.0) -> DataFrame:
    """Bring every series to the target level; values are clipped to full scale and a
    silent series stays as it is."""
    level = df.groupBy("series_id").agg(
        dbfs(_mean_square(), max_amp).alias("_db"), F.count(F.lit(1)).alias("_n")
    )
    factor = F.coalesce(F.pow(F.lit(10.0), (F.lit(target) - F.col("_db")) / 20), F.lit(1.0))
    scaled = F.greatest(F.least(F.col("v") * factor, F.lit(max_amp)), F.lit(-max_amp))
    joined = join_per_key(df, level, ["series_id"], "_n", SPREAD)
    return joined.withColumn("v", scaled).select(*df.columns)


def downmix(df: DataFrame) -> DataFrame:
    """Average of the channels, as channel 0."""
    return df.groupBy("series_id", "idx").agg(F.avg("v").alias("v")).select(
        "series_id", F.lit(0).alias("channel"), "idx", "v"
    )


def silence_threshold(
    level: Column, auto: bool = True, strict: bool = False, fixed: float = V.FIXED_SILENCE_DB
) -> Column:
    """The fixed threshold, or the level minus a margin, kept within -50..-15."""
    if not auto:
        return F.lit(float(fixed))
    margin = V.STRICT_MARGIN_DB if strict else V.SILENCE_MARGIN_DB
    # a silent series has no level, and the floor holds
    return F.greatest(F.least(F.coalesce(level, F.lit(float("-inf"))) - margin, F.lit(V.SILENCE_CEILING_DB)),
                      F.lit(V.SILENCE_FLOOR_DB))


def silence_limits(
    df: DataFrame, auto: bool = True, strict: bool = False, max_amp: float = 1.0, fixed: float = V.FIXED_SILENCE_DB
) -> DataFrame:
    """``(series_id, threshold, _limit)``: the threshold in dB and the mean square below
    which a piece is silent. Steps that follow each other share one table, taken before
    the first of them changes the level."""
    level = df.groupBy("series_id").agg(dbfs(_mean_square(), max_amp).alias("db"))
    return level.select("series_id", silence_threshold(F.col("db"), auto, strict, fixed).alias("threshold")).withColumn(
        "_limit", F.pow(F.pow(F.lit(10.0), F.col("threshold") / 20) * max_amp, F.lit(2.0)))


def _series(df: DataFrame, limits: DataFrame | None, auto: bool, strict: bool, max_amp: float) -> DataFrame:
    """Per series: length in samples and its silence limit."""
    sizes = df.groupBy("series_id").agg((F.max("idx") + 1).alias("_len"), F.count(F.lit(1)).alias("_n"))
    limits = silence_limits(df, auto, strict, max_amp) if limits is None else limits
    other = limits.select(F.col("series_id").alias("_id"), "_limit")
    return sizes.join(other, F.col("series_id").eqNullSafe(F.col("_id"))).drop("_id")


def trim_silence(
    df: DataFrame, rate: int, auto: bool = True, strict: bool = False, max_amp: float = 1.0,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Cut silence off both ends, in 5 ms steps; ``idx`` restarts at 0.

    Steps are counted in milliseconds, from the start for the head and from the end for
    the tail, so any rate is cut at the same times. A series without a loud step is gone.
    ``limits`` (``silence_limits``) replaces the threshold of the samples given.
    """
    series = _series(df, limits, auto, strict, max_amp)
    placed = join_per_key(df, series, ["series_id"], "_n", SPREAD)
    head = F.expr(f"idx * 1000L div {rate}L div {V.TRIM_STEP_MS}L")
    tail = F.expr(f"(_len - 1 - idx) * 1000L div {rate}L div {V.TRIM_STEP_MS}L")
    # level per step, for both alignments, in one pass
    steps = placed.select(
        "series_id", "_len", "_limit", (F.col("v") * F.col("v")).alias("sq"),
        F.explode(F.array(
            F.struct(F.lit(True).alias("head"), head.alias("no")),
            F.struct(F.lit(False).alias("head"), tail.alias("no")),
        )).alias("s"),
    )
    loud = (
        steps.groupBy("series_id", "_len", "s")
        .agg(F.avg("sq").alias("ms"), F.max("_limit").alias("_limit"))
        .where(F.col("ms") >= F.col("_limit"))
        .groupBy("series_id", "_len")
        .agg(
            F.min(F.when(F.col("s.head"), F.col("s.no"))).alias("a"),
            F.min(F.when(~F.col("s.head"), F.col("s.no"))).alias("b"),
        )
        .select("series_id", "_len", "a", "b", F.col("_len").alias("_n"))
    )
    kept = join_per_key(df, loud, ["series_id"], "_n", SPREAD).where((head >= F.col("a")) & (tail >= F.col("b")))
    first = F.expr(f"(a * {V.TRIM_STEP_MS * rate}L + 999L) div 1000L")
    return kept.withColumn("idx", F.col("idx") - first).select(*df.columns)


def gap_cells(
    df: DataFrame, rate: int, auto: bool = True, strict: bool = False, max_amp: float = 1.0,
    min_gap_ms: int = V.MIN_GAP_MS, keep_ms: int = V.KEEP_MS, stretch: int = STRETCH,
    limits: DataFrame | None = None,
) -> DataFrame:
    """``(series_id, ms, removed)`` for every millisecond of every series.

    Every 10 ms (and at the last possible place) a piece of ``min_gap_ms`` is tested
    for silence. Silent pieces that touch make a gap; all of it but ``keep_ms`` at
    each side goes, except at the ends of the series, where no sound is near. So a
    millisecond goes exactly if everything within ``keep_ms`` of it and inside the
    series is covered by silent pieces. That looks at most ``min_gap_ms + keep_ms``
    away, which is the overlap of the stretches.
    """
    series = _series(df, limits, auto, strict, max_amp)
    cells = df.groupBy("series_id", F.floor(F.col("idx") * 1000 / F.lit(rate)).alias("ms")).agg(
        F.sum(F.col("v") * F.col("v")).alias("sq"), F.count(F.lit(1)).alias("k")
    )
    bounds = series.select("series_id", "_n", "_limit", F.ceil(F.col("_len") * 1000 / F.lit(rate)).alias("_ms"))
    placed = join_per_key(cells, bounds, ["series_id"], "_n", ["ms"])
    halo = min_gap_ms + keep_ms
    tiled = tiles.add_tiles(placed, "ms", stretch, halo, halo)
    part = Window.partitionBy("series_id", "_tile")
    up, down = part.orderBy("ms"), part.orderBy(F.col("ms").desc())
    running = (Window.unboundedPreceding, Window.currentRow)

    # sums over a piece as differences of running sums: one addition per cell, whatever the piece length
    summed = tiled.withColumns({
        "_s": F.sum("sq").over(up.rowsBetween(*running)), "_c": F.sum("k").over(up.rowsBetween(*running)),
    })
    ahead = min_gap_ms - 1
    mean_square = (F.lead("_s", ahead).over(up) - F.col("_s") + F.col("sq")) / (
        F.lead("_c", ahead).over(up) - F.col("_c") + F.col("k")
    )
    last_start = F.col("_ms") - min_gap_ms
    is_start = ((F.col("ms") % V.GAP_STEP_MS == 0) & (F.col("ms") <= last_start)) | (F.col("ms") == last_start)
    tested = summed.select(
        "series_id", "_tile", "ms", "_ms", F.when(is_start, mean_square <= F.col("_limit")).alias("silent")
    )
    start = F.last(F.when(F.col("silent"), F.col("ms")), ignorenulls=True).over(up.rowsBetween(*running))
    covered = tested.withColumn("covered", F.coalesce(F.col("ms") - start < min_gap_ms, F.lit(False)))
    open_ms = F.when(~F.col("covered"), F.col("ms"))
    near = covered.withColumns({
        "_before": F.last(open_ms, ignorenulls=True).over(up.rowsBetween(*running)),
        "_after": F.last(open_ms, ignorenulls=True).over(down.rowsBetween(*running)),
    })
    # a range [s, e) keeps s .. s + keep_ms - 1 and e - keep_ms .. e - 1
    far = F.coalesce(F.col("ms") - F.col("_before") > keep_ms, F.lit(True)) & F.coalesce(
        F.col("_after") - F.col("ms") > keep_ms, F.lit(True)
    )
    return near.where(tiles.in_core("ms", stretch)).select(
        "series_id", "ms", (F.col("covered") & far).alias("removed"), "covered"
    )


def remove_gaps(
    df: DataFrame, rate: int, auto: bool = True, strict: bool = False, max_amp: float = 1.0,
    min_gap_ms: int = V.MIN_GAP_MS, keep_ms: int = V.KEEP_MS, stretch: int = STRETCH,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Shorten inner gaps; ``idx`` keeps its old values (use ``renumber``). A series that
    is silent throughout is returned whole."""
    cells = materialize(gap_cells(df, rate, auto, strict, max_amp, min_gap_ms, keep_ms, stretch, limits))
    per_series = cells.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("covered")).alias("_open")
    )
    cut = join_per_key(cells.where("removed"), per_series, ["series_id"], "_n", ["ms"])
    gone = cut.where("_open > 0").select("series_id", F.col("ms").alias("_ms"))
    # equality on (series, millisecond): a long series spreads over all tasks
    placed = df.withColumn("_ms", F.floor(F.col("idx") * 1000 / F.lit(rate)))
    return placed.join(gone, ["series_id", "_ms"], "left_anti").select(*df.columns)


def renumber(df: DataFrame, rows_per_bucket: int = O.ROWS_PER_BUCKET) -> DataFrame:
    """Close the holes of ``idx`` after samples were removed."""
    numbered = O.with_row_number(materialize(df), "idx", "_no", ["series_id", "channel"], rows_per_bucket)
    return numbered.withColumn("idx", F.col("_no") - 1).select(*df.columns)


def resample(df: DataFrame, rate: int, new_rate: int, bits: int | None = 16, stretch: int = STRETCH) -> DataFrame:
    """Straight-line resampling; with ``bits`` the values become whole steps of that depth.

    Every source sample emits the target samples between itself and the next one, so
    no grid is built. Target times at or past the last sample take its value.
    """
    tiled = tiles.add_tiles(df, "idx", stretch, 0, 1)
    w = Window.partitionBy("series_id", "channel", "_tile").orderBy("idx")
    # whole-number arithmetic: targets between samples i and i + 1 are ceil(i * new / old) ..
    first = F.expr(f"(idx * {new_rate}L + {rate - 1}L) div {rate}L")
    end = F.expr(f"((idx + 1) * {new_rate}L + {rate - 1}L) div {rate}L")
    grown = (
        tiled.withColumn("_next", F.lead("v").over(w))
        .where(tiles.in_core("idx", stretch) & (end > first))
        .withColumn("_j", F.explode(F.sequence(first, end - 1)))
    )
    t = (F.col("_j") * F.lit(rate) - F.col("idx") * F.lit(new_rate)) / F.lit(new_rate)
    value = F.col("v") + (F.coalesce("_next", "v") - F.col("v")) * t
    if bits:
        value = F.round(value * float(2 ** (bits - 1))).cast("long")
    return grown.select("series_id", "channel", F.col("_j").alias("idx"), value.alias("v"))


def thin_series(df: DataFrame, points: int = V.WAVEFORM_POINTS) -> DataFrame:
    """Every ``max(1, n div points)``-th sample of a series."""
    size = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_step", F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    )
    joined = join_per_key(df, size, ["series_id"], "_n", SPREAD)
    return joined.where(F.col("idx") % F.col("_step") == 0).select(*df.columns)


def signal_props(df: DataFrame, series: DataFrame, max_amp: float = 1.0) -> DataFrame:
    """``(series_id, duration_s, channels, layout, rate, bits, dbfs)``; ``series`` holds
    ``rate`` and ``width`` (bytes per sample). A series it lacks has null rate and duration."""
    measured = df.groupBy("series_id").agg(
        (F.max("idx") + 1).alias("n"), F.count_distinct("channel").alias("channels"),
        dbfs(_mean_square(), max_amp).alias("dbfs"),
    )
    return measured.join(series, "series_id", "left").select(
        "series_id", (F.col("n") / F.col("rate")).alias("duration_s"), "channels",
        F.when(F.col("channels") == 1, "Mono").otherwise("Stereo").alias("layout"),
        "rate", (F.col("width") * 8).alias("bits"), "dbfs",
    )


def duration_compare(original: DataFrame, processed: DataFrame, rate: int, new_rate: int | None = None) -> DataFrame:
    """``(series_id, orig_dur, new_dur)`` in seconds; a series that is gone has 0."""

    def seconds(df: DataFrame, name: str, r: int) -> DataFrame:
        per_channel = df.groupBy("series_id", "channel").agg(F.count(F.lit(1)).alias("n"))
        return per_channel.groupBy("series_id").agg((F.max("n") / r).alias(name))

    return seconds(original, "orig_dur", rate).join(
        seconds(processed, "new_dur", new_rate or rate), "series_id", "left"
    ).fillna(0.0, ["new_dur"])
