"""Video planning queries over metadata made from the parts table."""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.operators import frames as M

META = """(select p_partkey as id, 320 + p_size * 40 as width, 240 + (p_partkey % 50) * 40 as height,
  p_partkey % 4 * 15 as fps, p_size * 100 as frames, p_partkey * 7919 % 50000000 as bytes from part)"""


def meta(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), (320 + F.col("p_size") * 40).alias("width"), (240 + k % 50 * 40).alias("height"),
        (k % 4 * 15).alias("fps"), (F.col("p_size") * 100).alias("frames"), (k * 7919 % 50000000).alias("bytes"),
    )


@query(
    "video_preset",
    f"""select id, width, height, case when height > width then 720 else 1280 end::bigint as target_width,
    case when height > width then 1280 else 720 end::bigint as target_height from {META}""",
)
def video_preset(spark, sf):
    return M.video_preset(meta(spark, sf), "720p HD").select("id", "width", "height", "target_width", "target_height")


@query(
    "video_plan",
    f"""with o as (select *, ['gif', 'remove_audio', 'compress', 'standard'][id % 4 + 1] as operation,
      case when fps > 0 then frames / fps else 0 end as secs, case when fps > 0 then fps else 30 end as known from {META})
    select id, case operation when 'gif' then 480 when 'standard' then case when height > width then 480 else 854 end else width end::bigint as target_width,
     case operation when 'gif' then (960 * height + width) // (2 * width) when 'standard' then case when height > width then 854 else 480 end else height end::bigint as target_height,
     case operation when 'gif' then 15 when 'standard' then known else fps end::double as target_fps,
     round(secs, 6) as duration_s, operation, case operation when 'gif' then '.gif' else '.mp4' end as suffix,
     case operation when 'gif' then round(least(secs, 5) * 15) else least(frames, 5 * known) end::bigint as frames_out from o""",
)
def video_plan(spark, sf):
    way = F.col("id") % 4
    p = M.video_plan(meta(spark, sf), "480p SD", preview=True, gif=way == 0, remove_audio=way == 1, compress=way == 2)
    return p.select(
        "id", "target_width", "target_height", "target_fps", F.round("duration_s", 6).alias("duration_s"),
        "operation", "suffix", "frames_out",
    )


@query(
    "video_operation",
    """select p_partkey as id, case when p_size % 2 = 0 then 'gif' when p_size % 3 = 0 then 'remove_audio'
      when p_size % 5 = 0 then 'compress' else 'standard' end as operation from part""",
)
def video_operation(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), M.operation_of(s % 2 == 0, s % 3 == 0, s % 5 == 0).alias("operation")
    )


# One frame per event: the user is the video, the rank of the event its frame number.
FRAMES = """(select user_id as video_id, row_number() over (partition by user_id order by event_id) - 1 as frame_idx,
  (row_number() over (partition by user_id order by event_id) - 1) / 24 as ts_s, user_id % 4 + 1 as fps from events)"""


def frame_table(spark, sf):
    from scrubline.plans.ordered import with_row_number

    e = with_row_number(table(spark, sf, "events").select("event_id", "user_id"), "event_id", "rn", ["user_id"])
    idx = F.col("rn") - 1
    return e.select(
        F.col("user_id").alias("video_id"), idx.alias("frame_idx"), (idx / 24).alias("ts_s"),
        (F.col("user_id") % 4 + 1).alias("fps"),
    )


@query("frame_preview", f"select video_id, frame_idx from {FRAMES} where frame_idx < 5 * fps")
def frame_preview(spark, sf):
    return M.frame_preview(frame_table(spark, sf)).select("video_id", "frame_idx")


@query(
    "middle_frame",
    f"""select video_id, frame_idx from (select *, count(*) over (partition by video_id) as n from {FRAMES}) where frame_idx = n // 2""",
)
def middle_frame(spark, sf):
    return M.middle_frame(frame_table(spark, sf)).select("video_id", "frame_idx")


@query(
    "frame_sample",
    f"""select video_id, floor(ts_s * 15)::bigint as slot, min(frame_idx) as frame_idx from {FRAMES} group by 1, 2""",
)
def frame_sample(spark, sf):
    return M.frame_sample(frame_table(spark, sf))


@query(
    "spec_compare",
    f"""with o as (select * from {META}), p as (select id, case when height > width then 720 else 1280 end as width,
      case when height > width then 1280 else 720 end as height, case when fps > 0 then fps else 30 end as fps, frames, bytes // 3 as bytes from {META}),
    s as (select o.id, unnest([
      {{'metric': 'Width', 'original': o.width::double, 'processed': p.width::double}},
      {{'metric': 'Height', 'original': o.height::double, 'processed': p.height::double}},
      {{'metric': 'FPS', 'original': o.fps::double, 'processed': p.fps::double}},
      {{'metric': 'Duration (s)', 'original': case when o.fps > 0 then round_even(o.frames / o.fps, 2) else 0 end, 'processed': round_even(p.frames / p.fps, 2)}},
      {{'metric': 'Size (MB)', 'original': round_even(o.bytes / 1048576, 2), 'processed': round_even(p.bytes / 1048576, 2)}}]) as u
      from o join p using (id))
    select id, u.metric as metric, u.original as original, u.processed as processed from s""",
)
def spec_compare(spark, sf):
    original = meta(spark, sf)
    plan = M.video_plan(original, "720p HD")
    processed = plan.select(
        "id", F.col("target_width").alias("width"), F.col("target_height").alias("height"),
        F.col("target_fps").alias("fps"), "frames", F.floor(F.col("bytes") / 3).alias("bytes"),
    )
    return M.spec_compare(original, processed)
