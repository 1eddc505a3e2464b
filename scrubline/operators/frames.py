"""Video planning over a metadata table and a frame table ``(video_id, frame_idx, ts_s)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V


def target_fps(fps: Column, requested: float | None = None) -> Column:
    """The requested rate, else the source's, else 30 where that is not positive."""
    chosen = F.coalesce(F.lit(requested).cast("double"), fps.cast("double"))
    return F.when(chosen > 0, chosen).otherwise(F.lit(V.DEFAULT_FPS))


def duration(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def operation(gif: bool = False, remove_audio: bool = False, compress: bool = False) -> str:
    """The first option that is on decides how a video is handled."""
    for name, on in (("gif", gif), ("remove_audio", remove_audio), ("compress", compress)):
        if on:
            return name
    return "standard"


def operation_of(gif: Column, remove_audio: Column, compress: Column) -> Column:
    """The same choice for options held per row."""
    return (
        F.when(gif, "gif").when(remove_audio, "remove_audio").when(compress, "compress").otherwise("standard")
    )


def video_preset(df: DataFrame, preset: str | None) -> DataFrame:
    """Add ``target_width`` and ``target_height``; portrait videos swap the sides."""
    if preset is None:
        w, h = F.col("width"), F.col("height")
    else:
        pw, ph = V.VIDEO_PRESETS[preset]
        portrait = F.col("height") > F.col("width")
        w, h = F.when(portrait, ph).otherwise(pw), F.when(portrait, pw).otherwise(ph)
    return df.withColumns({"target_width": w.cast("long"), "target_height": h.cast("long")})


def video_plan(
    df: DataFrame, preset: str | None = None, fps: float | None = None, preview: bool = False,
    gif: bool | Column = False, remove_audio: bool | Column = False, compress: bool | Column = False,
) -> DataFrame:
    """Metadata with operation, target size and rate, duration, suffix and frames to write.

    The operation decides the output. A GIF is 480 wide with its sides in proportion, at
    15 frames a second; removing sound and compressing change neither size nor rate; only
    the standard way follows ``preset`` and ``fps``. A preview is the first five seconds
    at the rate of its operation. The three options are booleans or columns.
    """
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    op = operation_of(flag(gif), flag(remove_audio), flag(compress))
    is_gif, standard = op == "gif", op == "standard"
    own, seconds = F.col("fps").cast("double"), duration(F.col("frames"), F.col("fps"))
    rate = F.when(is_gif, F.lit(float(V.GIF_FPS))).when(standard, target_fps(F.col("fps"), fps)).otherwise(own)
    width, height = F.col("width").cast("long"), F.col("height").cast("long")
    in_gif = F.floor(F.lit(V.GIF_WIDTH) * height / width + 0.5)
    shown = F.least(seconds, F.lit(V.PREVIEW_SECONDS)) if preview else seconds
    frames = F.col("frames").cast("long")
    # a source without a rate has no seconds to cut at; 30 stands in for it
    first = F.least(frames, (V.PREVIEW_SECONDS * F.when(rate > 0, rate).otherwise(F.lit(V.DEFAULT_FPS))).cast("long"))
    sized = video_preset(df, preset)
    return sized.withColumns({
        "target_width": F.when(is_gif, F.lit(V.GIF_WIDTH)).when(standard, F.col("target_width")).otherwise(width),
        "target_height": F.when(is_gif, in_gif).when(standard, F.col("target_height")).otherwise(height),
        "target_fps": rate,
        "duration_s": seconds,
        "operation": op,
        "suffix": F.when(is_gif, ".gif").otherwise(".mp4"),
        "frames_out": F.when(is_gif, F.round(shown * V.GIF_FPS).cast("long")).otherwise(first if preview else frames),
    })


def frame_preview(frames: DataFrame, fps: str = "fps", seconds: float = V.PREVIEW_SECONDS) -> DataFrame:
    """The first ``int(seconds * fps)`` frames of every video; ``fps`` is a column."""
    return frames.where(F.col("frame_idx") < (seconds * F.col(fps)).cast("long"))


def middle_frame(frames: DataFrame) -> DataFrame:
    """Frame number ``n div 2`` of every video, joined on video and frame, so a long
    video spreads over all tasks."""
    wanted = frames.groupBy("video_id").agg((F.count(F.lit(1)) / 2).cast("long").alias("frame_idx"))
    return frames.join(wanted.select("video_id", "frame_idx"), ["video_id", "frame_idx"])


def frame_sample(frames: DataFrame, fps: int = V.GIF_FPS) -> DataFrame:
    """The first frame of every ``1 / fps`` second slot, merged before the shuffle."""
    return frames.groupBy("video_id", F.floor(F.col("ts_s") * fps).alias("slot")).agg(
        F.min("frame_idx").alias("frame_idx")
    )


def spec_compare(original: DataFrame, processed: DataFrame) -> DataFrame:
    """``(id, metric, original, processed)`` of size, rate, duration and megabytes."""

    def specs(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            "id",
            F.struct(
                F.col("width").cast("double").alias("Width"),
                F.col("height").cast("double").alias("Height"),
                F.bround(F.col("fps").cast("double"), 2).alias("FPS"),
                F.bround(duration(F.col("frames"), F.col("fps")), 2).alias("Duration (s)"),
                F.bround(F.col("bytes") / 1048576, 2).alias("Size (MB)"),
            ).alias(side),
        )

    both = specs(original, "o").join(specs(processed, "p"), "id")
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col("o")[m].alias("original"), F.col("p")[m].alias("processed"))
        for m in ("Width", "Height", "FPS", "Duration (s)", "Size (MB)")
    ]
    return both.select("id", F.inline(F.array(*rows)))
