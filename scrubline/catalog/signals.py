"""Sound queries over sample tables made from the embeddings, 1000 samples per second."""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.operators import signal as S
from scrubline.plans.clean_signal import SignalOptions, clean_signal
from scrubline.plans.ordered import with_row_number

RATE = 1000
STRETCH = 2048

# Series laid end to end by vec_id; two channels, the second shifted by one place.
# Silent where idx mod 3000 lies in 1000..1999, and over the first 120 samples.
STEREO = """(select label as series_id, ch::int as channel, k * 64 + p as idx,
   embedding[(p + ch) % 64 + 1]::double * case when (k * 64 + p) % 3000 between 1000 and 1999 or k * 64 + p < 120 then 0.0001::double else 1 end as v
 from (select *, row_number() over (partition by label order by vec_id) - 1 as k from embeddings),
  unnest(range(64)) as a(p), unnest(range(2)) as b(ch))"""
MONO = f"(select series_id, 0 as channel, idx, v from {STEREO} where channel = 0)"


# Long silent ends, and a faint passage between two loud ones.
FAINT = """(select label as series_id, 0 as channel, k * 64 + p as idx, embedding[p % 64 + 1]::double
   * case when k * 64 + p < 1200 or k * 64 + p >= 2500 then 0.0001::double when k * 64 + p between 1500 and 2199 then 0.18::double else 1 end as v
 from (select *, row_number() over (partition by label order by vec_id) - 1 as k from embeddings), unnest(range(64)) as a(p))"""


QUIET_FACTOR = "case when idx % 3000 between 1000 and 1999 or idx < 120 then 0.0001D else 1D end"
FAINT_FACTOR = "case when idx < 1200 or idx >= 2500 then 0.0001D when idx between 1500 and 2199 then 0.18D else 1D end"


def stereo(spark, sf, factor=QUIET_FACTOR):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    e = with_row_number(e, "vec_id", "k", ["label"])
    s = e.select(
        F.col("label").alias("series_id"), "k", "embedding", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("channel")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    s = s.withColumn("idx", (F.col("k") - 1) * 64 + F.col("p"))
    value = F.get("embedding", ((F.col("p") + F.col("channel")) % 64).cast("int")).cast("double")
    return s.select("series_id", "channel", "idx", (value * F.expr(factor)).alias("v"))


def mono(spark, sf):
    return stereo(spark, sf).where("channel = 0")


def faint(spark, sf):
    return stereo(spark, sf, FAINT_FACTOR).where("channel = 0")


LEVEL = "case when avg(v * v) > 0 then 20 * log10(sqrt(avg(v * v))) end"


@query("signal_level", f"select series_id, round({LEVEL}, 4) as dbfs from {STEREO} group by series_id")
def signal_level(spark, sf):
    return S.signal_level(stereo(spark, sf)).withColumn("dbfs", F.round("dbfs", 4))


@query(
    "signal_gain",
    f"""with l as (select series_id, {LEVEL} as db from {STEREO} group by series_id)
    select series_id, channel, idx, round(greatest(-1, least(1, v * pow(10::double, (-20 - db) / 20))), 6) as v
    from {STEREO} join l using (series_id)""",
)
def signal_gain(spark, sf):
    return S.signal_gain(stereo(spark, sf)).withColumn("v", F.round("v", 6))


# Series 0 has lost its name; it is a series all the same.
@query(
    "signal_gain_null_series",
    f"""with m as materialized (select nullif(series_id, 0) as series_id, channel, idx, v from {MONO}),
    l as (select series_id, {LEVEL} as db from m group by series_id)
    select m.series_id, channel, idx, round(greatest(-1, least(1, v * pow(10::double, (-20 - db) / 20))), 6) as v
    from m join l on m.series_id is not distinct from l.series_id""",
)
def signal_gain_null_series(spark, sf):
    m = mono(spark, sf).withColumn("series_id", F.nullif("series_id", F.lit(0)))
    return S.signal_gain(m).withColumn("v", F.round("v", 6))


@query("downmix", f"select series_id, 0 as channel, idx, round(avg(v), 6) as v from {STEREO} group by series_id, idx")
def downmix(spark, sf):
    return S.downmix(stereo(spark, sf)).withColumn("v", F.round("v", 6))


SERIES = f"""series as materialized (select series_id, max(idx) + 1 as len,
  pow(10::double, greatest(-50, least(-15, {LEVEL} - 10)) / 20) as amp from {MONO} group by series_id)"""


@query(
    "silence_threshold",
    f"""select series_id, round(greatest(-50, least(-15, {LEVEL} - 10)), 4) as standard,
      round(greatest(-50, least(-15, {LEVEL} - 6)), 4) as strict, -40.0::double as fixed from {MONO} group by series_id""",
)
def silence_threshold(spark, sf):
    level = S.signal_level(mono(spark, sf))
    return level.select(
        "series_id", F.round(S.silence_threshold(F.col("dbfs")), 4).alias("standard"),
        F.round(S.silence_threshold(F.col("dbfs"), strict=True), 4).alias("strict"),
        S.silence_threshold(F.col("dbfs"), auto=False).alias("fixed"),
    )


@query(
    "trim_silence",
    f"""with {SERIES},
    head as (select series_id, min(c) as c from (select series_id, idx // 5 as c, sqrt(avg(v * v)) as r from {MONO} group by 1, 2)
      join series using (series_id) where r >= amp group by series_id),
    tail as (select series_id, min(c) as c from (select series_id, (len - 1 - idx) // 5 as c, sqrt(avg(v * v)) as r
      from {MONO} join series using (series_id) group by 1, 2) join series using (series_id) where r >= amp group by series_id)
    select series_id, channel, idx - head.c * 5 as idx, round(v, 6) as v from {MONO} join series using (series_id)
     join head using (series_id) join tail using (series_id) where idx >= head.c * 5 and idx < len - tail.c * 5""",
)
def trim_silence(spark, sf):
    return S.trim_silence(mono(spark, sf), RATE).withColumn("v", F.round("v", 6))


def _trim_sql(rate: int) -> str:
    """Cuts at whole 5 ms steps of a rate that no step divides."""
    return f"""with m as materialized (select * from {FAINT}), s as (select series_id, max(idx) + 1 as len,
      pow(10::double, greatest(-50, least(-15, {LEVEL} - 10)) / 20) as amp from m group by series_id),
    head as (select series_id, min(c) as c from (select series_id, idx * 1000 // {rate} // 5 as c, sqrt(avg(v * v)) as r from m group by 1, 2)
      join s using (series_id) where r >= amp group by series_id),
    tail as (select series_id, min(c) as c from (select series_id, (len - 1 - idx) * 1000 // {rate} // 5 as c, sqrt(avg(v * v)) as r
      from m join s using (series_id) group by 1, 2) join s using (series_id) where r >= amp group by series_id)
    select series_id, channel, idx - (head.c * 5 * {rate} + 999) // 1000 as idx, round(v, 6) as v from m join s using (series_id)
     join head using (series_id) join tail using (series_id)
    where idx * 1000 // {rate} // 5 >= head.c and (len - 1 - idx) * 1000 // {rate} // 5 >= tail.c"""


@query("trim_silence_44k", _trim_sql(44_100))
def trim_silence_44k(spark, sf):
    return S.trim_silence(faint(spark, sf), 44_100).withColumn("v", F.round("v", 6))


@query("trim_silence_11k", _trim_sql(11_025))
def trim_silence_11k(spark, sf):
    return S.trim_silence(faint(spark, sf), 11_025).withColumn("v", F.round("v", 6))


# Textbook form: test pieces, merge the silent ones into islands, cut the islands.
GAPS = f"""{SERIES},
  r as (select series_id, idx, sqrt(avg(v * v) over (partition by series_id order by idx rows between current row and 499 following)) as r
    from {MONO}),
  st as (select series_id, idx as i, len from r join series using (series_id)
    where (idx % 10 = 0 or idx = len - 500) and idx <= len - 500 and r <= amp),
  f as (select *, case when i - lag(i) over (partition by series_id order by i) <= 500 then 0 else 1 end as new from st),
  g as (select *, sum(new) over (partition by series_id order by i rows unbounded preceding) as g from f),
  isl as (select series_id, g, min(i) as s, max(i) + 500 as e, max(len) as len from g group by series_id, g),
  cut as (select series_id, case when s = 0 then 0 else s + 250 end as a, case when e = len then len else e - 250 end as b
    from isl where not (s = 0 and e = len))"""


@query(
    "remove_gaps",
    f"""with {GAPS} select m.series_id, m.channel, m.idx, round(m.v, 6) as v from {MONO} m
    where not exists (select 1 from cut where cut.series_id = m.series_id and m.idx >= a and m.idx < b)""",
)
def remove_gaps(spark, sf):
    return S.remove_gaps(mono(spark, sf), RATE, stretch=STRETCH).withColumn("v", F.round("v", 6))


@query(
    "remove_gaps_renumbered",
    f"""with {GAPS} select m.series_id, m.channel, row_number() over (partition by m.series_id order by m.idx) - 1 as idx, round(m.v, 6) as v from {MONO} m
    where not exists (select 1 from cut where cut.series_id = m.series_id and m.idx >= a and m.idx < b)""",
)
def remove_gaps_renumbered(spark, sf):
    kept = S.remove_gaps(mono(spark, sf), RATE, stretch=STRETCH)
    return S.renumber(kept, rows_per_bucket=4096).withColumn("v", F.round("v", 6))


def _resample_sql(new: int, bits: int) -> str:
    return f"""with n as (select series_id, max(idx) + 1 as n from {MONO} group by series_id),
    g as (select series_id, unnest(range((n * {new} + {RATE - 1}) // {RATE})) as j, n from n),
    t as (select series_id, j, j * {RATE} // {new} as i, (j * {RATE} % {new}) / {new}::double as f from g)
    select t.series_id, 0 as channel, t.j as idx, round((a.v + (coalesce(b.v, a.v) - a.v) * f) * {2 ** (bits - 1)})::bigint as v
    from t join {MONO} a on a.series_id = t.series_id and a.idx = t.i
    left join {MONO} b on b.series_id = t.series_id and b.idx = t.i + 1"""


@query("resample", _resample_sql(640, 16))
def resample(spark, sf):
    return S.resample(mono(spark, sf), RATE, 640, 16, STRETCH)


@query("resample_up", _resample_sql(1500, 24))
def resample_up(spark, sf):
    return S.resample(mono(spark, sf), RATE, 1500, 24, STRETCH)


@query(
    "thin_series",
    f"""with n as (select series_id, greatest(1, count(*) // 500) as step from {MONO} group by series_id)
    select series_id, channel, idx, round(v, 6) as v from {MONO} join n using (series_id) where idx % step = 0""",
)
def thin_series(spark, sf):
    return S.thin_series(mono(spark, sf), 500).withColumn("v", F.round("v", 6))


@query(
    "signal_props",
    f"""select series_id, round((max(idx) + 1) / 1000, 6) as duration_s, count(distinct channel) as channels, 'Stereo' as layout,
     1000 as rate, 16 as bits, round({LEVEL}, 4) as dbfs from {STEREO} group by series_id""",
)
def signal_props(spark, sf):
    samples = stereo(spark, sf)
    series = table(spark, sf, "embeddings").select(F.col("label").alias("series_id")).distinct().select(
        "series_id", F.lit(RATE).alias("rate"), F.lit(2).alias("width")
    )
    return S.signal_props(samples, series).withColumns({"dbfs": F.round("dbfs", 4), "duration_s": F.round("duration_s", 6)})


@query(
    "duration_compare",
    f"""with {GAPS}, kept as (select m.series_id, count(*) as k from {MONO} m
      where not exists (select 1 from cut where cut.series_id = m.series_id and m.idx >= a and m.idx < b) group by 1)
    select series_id, round(len / 1000, 6) as orig_dur, round(coalesce(k, 0) / 1000, 6) as new_dur from series left join kept using (series_id)""",
)
def duration_compare(spark, sf):
    m = mono(spark, sf)
    d = S.duration_compare(m, S.remove_gaps(m, RATE, stretch=STRETCH), RATE)
    return d.withColumns({c: F.round(c, 6) for c in ("orig_dur", "new_dur")})


# The threshold is taken once, on the levelled sound before trimming.
PLAN = f"""g as (select series_id, {LEVEL} as db from {FAINT} group by series_id),
  src as materialized (select series_id, idx, greatest(-1, least(1, v * pow(10::double, (-20 - db) / 20))) as v from {FAINT} join g using (series_id)),
  th as (select series_id, max(idx) + 1 as len, greatest(-50, least(-15, {LEVEL} - 10)) as db from src group by series_id),
  series as materialized (select series_id, len, db, pow(10::double, db / 20) as amp from th),
  head as (select series_id, min(c) as c from (select series_id, idx // 5 as c, sqrt(avg(v * v)) as r from src group by 1, 2)
    join series using (series_id) where r >= amp group by series_id),
  tail as (select series_id, min(c) as c from (select series_id, (len - 1 - idx) // 5 as c, sqrt(avg(v * v)) as r
    from src join series using (series_id) group by 1, 2) join series using (series_id) where r >= amp group by series_id),
  t as materialized (select series_id, idx - head.c * 5 as idx, v, amp from src join series using (series_id)
    join head using (series_id) join tail using (series_id) where idx >= head.c * 5 and idx < len - tail.c * 5),
  tl as (select series_id, max(idx) + 1 as len, max(amp) as amp from t group by series_id),
  r as (select series_id, idx, sqrt(avg(v * v) over (partition by series_id order by idx rows between current row and 499 following)) as r from t),
  st as (select series_id, idx as i, len from r join tl using (series_id)
    where (idx % 10 = 0 or idx = len - 500) and idx <= len - 500 and r <= amp),
  f as (select *, case when i - lag(i) over (partition by series_id order by i) <= 500 then 0 else 1 end as new from st),
  n as (select *, sum(new) over (partition by series_id order by i rows unbounded preceding) as n from f),
  isl as (select series_id, n, min(i) as s, max(i) + 500 as e, max(len) as len from n group by series_id, n),
  cut as (select series_id, case when s = 0 then 0 else s + 250 end as a, case when e = len then len else e - 250 end as b
    from isl where not (s = 0 and e = len)),
  kept as (select * from t where not exists (select 1 from cut where cut.series_id = t.series_id and t.idx >= a and t.idx < b))"""


@query(
    "clean_signal",
    f"""with {PLAN} select series_id, 0 as channel, row_number() over (partition by series_id order by idx) - 1 as idx, round(v, 6) as v from kept""",
)
def plan_of_sounds(spark, sf):
    return clean_signal(faint(spark, sf), RATE, SignalOptions(convert=False))[0].withColumn("v", F.round("v", 6))


@query(
    "clean_signal_steps",
    f"""with {PLAN}, c as (select series_id, len as n0, db, (select count(*) from t where t.series_id = series.series_id) as n1,
      (select count(*) from kept where kept.series_id = series.series_id) as n2 from series),
    l as (select series_id, list_filter(['Normalized to -20dB', format('Auto-Threshold: {{:.1f}}dB', db),
      case when n1 < n0 then 'Trimmed Silence' end, case when n2 < n1 then 'Removed internal gaps' end, 'Format: 8000Hz, 16-bit'], lambda x: x is not null) as s from c)
    select series_id, generate_subscripts(s, 1)::int as step_no, unnest(s) as step from l""",
)
def clean_signal_steps(spark, sf):
    return clean_signal(faint(spark, sf), RATE, SignalOptions(rate=8000))[1]
