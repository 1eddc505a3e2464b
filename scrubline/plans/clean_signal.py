"""The sound plan: gain, mono, silence trimming, gap removal, format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.operators import signal
from scrubline.plans.materialize import materialize


@dataclass(frozen=True)
class SignalOptions:
    mono: bool = True
    auto_threshold: bool = True
    silence_thresh: float = V.FIXED_SILENCE_DB
    strict: bool = False
    trim: bool = True
    remove_gaps: bool = True
    min_gap: int = V.MIN_GAP_MS
    convert: bool = True
    rate: int = 16_000
    width: int = 2


def clean_signal(df: DataFrame, rate: int, options: SignalOptions = SignalOptions()) -> tuple[DataFrame, DataFrame]:
    """The processed samples, and the steps of every series as ``(series_id, step_no, step)``.

    The silence threshold of a series is fixed once, after gain and mono, and holds for
    both trimming and gaps. A step is listed where it changed the series. Each step that
    reads its input more than once gets it from the shared folder.
    """
    df = signal.signal_gain(df)
    facts = df.groupBy("series_id").agg((F.max("channel") > F.min("channel")).alias("many"))
    steps: list[tuple[Column, Column]] = [(F.lit(True), F.lit(V.SIGNAL_STEPS["gain"]))]
    if options.mono:
        df = signal.downmix(df)
        steps.append((F.col("many"), F.lit(V.SIGNAL_STEPS["mono"])))
    if options.trim or options.remove_gaps or options.auto_threshold:
        df = materialize(df)
        limits = materialize(signal.silence_limits(df, options.auto_threshold, options.strict, fixed=options.silence_thresh))
        facts = _with(facts, limits, "threshold")
        if options.auto_threshold:
            steps.append((F.lit(True), F.format_string(V.SIGNAL_STEPS["threshold"], "threshold")))
        facts = _with(facts, _sizes(df, "n0"), "n0")
    if options.trim:
        df = materialize(signal.trim_silence(df, rate, limits=limits))
        facts = _with(facts, _sizes(df, "n1"), "n1")
        steps.append((F.coalesce("n1", F.lit(0)) < F.col("n0"), F.lit(V.SIGNAL_STEPS["trim"])))
    if options.remove_gaps:
        df = materialize(signal.renumber(signal.remove_gaps(df, rate, min_gap_ms=options.min_gap, limits=limits)))
        facts = _with(facts, _sizes(df, "n2"), "n2")
        before = F.coalesce("n1", F.lit(0)) if options.trim else F.col("n0")
        steps.append((F.coalesce("n2", F.lit(0)) < before, F.lit(V.SIGNAL_STEPS["gaps"])))
    if options.convert:
        df = signal.resample(df, rate, options.rate, options.width * 8)
        steps.append((F.lit(True), F.lit(V.SIGNAL_STEPS["format"] % (options.rate, options.width * 8))))
    listed = F.array_compact(F.array(*[F.when(holds, text) for holds, text in steps]))
    report = facts.select("series_id", F.posexplode(listed).alias("step_no", "step"))
    return df, report.withColumn("step_no", F.col("step_no") + 1)


def _sizes(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("series_id").agg((F.max("idx") + 1).alias(name))


def _with(facts: DataFrame, per_series: DataFrame, column: str) -> DataFrame:
    """One more column of the per-series table; null where a series is gone."""
    other = per_series.select(F.col("series_id").alias("_id"), column)
    return facts.join(other, F.col("series_id").eqNullSafe(F.col("_id")), "left").drop("_id")
