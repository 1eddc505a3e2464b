"""Null filling queries.

The ordered ones ask for small order buckets, so that values cross bucket edges
at every scale.
"""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.operators import fill
from scrubline.options import FillOptions

GAPPY = """(select event_id, user_id,
  case when event_id % 7 = 0 or event_id % 1000 between 300 and 600 then null else value end as v,
  case when event_id % 5 = 0 then null else event_type end as c from events)"""


def gappy_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("c"),
    )


def wide_gaps(spark, sf):
    """Long gaps on top, so whole order buckets can be empty."""
    return gappy_events(spark, sf).withColumn(
        "v", F.when(~(F.col("event_id") % 1000).between(300, 600), F.col("v"))
    )


def buckets(spark, sf) -> int:
    return max(1, table(spark, sf, "events").count() // 30)


@query("fill_mean", f"select event_id, round(coalesce(v, avg(v) over ()), 6) as v, c from {GAPPY}")
def fill_mean(spark, sf):
    df = fill.fill_mean(wide_gaps(spark, sf), ["v", "c"])
    return df.select("event_id", F.round("v", 6).alias("v"), "c")


@query(
    "fill_median",
    f"select event_id, round(coalesce(v, (select quantile_cont(v, 0.5) from {GAPPY})), 6) as v, c from {GAPPY}",
)
def fill_median(spark, sf):
    df = fill.fill_median(wide_gaps(spark, sf), ["v", "c"])
    return df.select("event_id", F.round("v", 6).alias("v"), "c")


def _mode(c: str) -> str:
    return f"(select {c} from {GAPPY} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@query("fill_mode", f"select event_id, coalesce(v, {_mode('v')}) as v, coalesce(c, {_mode('c')}) as c from {GAPPY}")
def fill_mode(spark, sf):
    return fill.fill_mode(wide_gaps(spark, sf), ["v", "c"]).select("event_id", "v", "c")


@query("fill_zero", f"select event_id, coalesce(v, 0) as v, coalesce(c, '0') as c from {GAPPY}")
def fill_zero(spark, sf):
    return fill.fill_zero(wide_gaps(spark, sf), ["v", "c"]).select("event_id", "v", "c")


@query("fill_custom", f"select event_id, coalesce(v, -1.5) as v, coalesce(c, '-1.5') as c from {GAPPY}")
def fill_custom(spark, sf):
    return fill.fill_custom(wide_gaps(spark, sf), ["v", "c"], "-1.5").select("event_id", "v", "c")


def _near(c: str, forward: bool, part: str = "") -> str:
    order = "event_id" if forward else "event_id desc"
    return f"last_value({c} ignore nulls) over ({part} order by {order} rows unbounded preceding)"


def _filled(first: bool, part: str = "") -> str:
    cells = ", ".join(f"coalesce({c}, {_near(c, first, part)}, {_near(c, not first, part)}) as {c}" for c in "vc")
    return f"select event_id, {cells} from {GAPPY}"


@query("fill_forward", _filled(True))
def fill_forward(spark, sf):
    df = fill.fill_ordered(wide_gaps(spark, sf), ["v", "c"], "event_id", rows_per_bucket=buckets(spark, sf))
    return df.select("event_id", "v", "c")


@query("fill_backward", _filled(False))
def fill_backward(spark, sf):
    df = fill.fill_ordered(wide_gaps(spark, sf), ["v", "c"], "event_id", "backward", rows_per_bucket=buckets(spark, sf))
    return df.select("event_id", "v", "c")


@query("fill_forward_by_user", _filled(True, "partition by user_id"))
def fill_forward_by_user(spark, sf):
    df = fill.fill_ordered(
        wide_gaps(spark, sf), ["v", "c"], "event_id", partition_by=["user_id"], rows_per_bucket=buckets(spark, sf)
    )
    return df.select("event_id", "v", "c")


def _line(part: str = "") -> str:
    up = f"over ({part} order by event_id rows unbounded preceding)"
    down = f"over ({part} order by event_id desc rows unbounded preceding)"
    return f"""with p as (select *, row_number() over ({part} order by event_id) as rn from {GAPPY}),
    q as (select *, case when v is not null then rn end as k from p),
    n as (select event_id, v, c, rn, last_value(v ignore nulls) {up} as v0, last_value(k ignore nulls) {up} as k0,
      last_value(v ignore nulls) {down} as v1, last_value(k ignore nulls) {down} as k1,
      last_value(c ignore nulls) {up} as c0 from q)
    select event_id, round(case when v is not null then v when v0 is null then null when v1 is null then v0
      else v0 + (v1 - v0) * (rn - k0) / (k1 - k0) end, 6) as v, coalesce(c, c0) as c from n"""


@query("fill_interpolate", _line())
def fill_interpolate(spark, sf):
    df = fill.fill_interpolate(wide_gaps(spark, sf), ["v", "c"], "event_id", rows_per_bucket=buckets(spark, sf))
    return df.select("event_id", F.round("v", 6).alias("v"), "c")


@query("fill_interpolate_by_user", _line("partition by user_id"))
def fill_interpolate_by_user(spark, sf):
    df = fill.fill_interpolate(
        wide_gaps(spark, sf), ["v", "c"], "event_id", ["user_id"], rows_per_bucket=buckets(spark, sf)
    )
    return df.select("event_id", F.round("v", 6).alias("v"), "c")


@query("fill_text_forward", f"select event_id, coalesce(c, {_near('c', True)}) as c from {GAPPY}")
def fill_text_forward(spark, sf):
    df = fill.fill_interpolate(wide_gaps(spark, sf), ["c"], "event_id", rows_per_bucket=buckets(spark, sf))
    return df.select("event_id", "c")


@query(
    "fill_per_column",
    f"select event_id, user_id, round(coalesce(v, avg(v) over ()), 6) as v, coalesce(c, {_mode('c')}) as c from {GAPPY}",
)
def fill_per_column(spark, sf):
    """The defaults by type: mean for numbers, mode for the rest."""
    return fill.fill_nulls(wide_gaps(spark, sf), FillOptions()).withColumn("v", F.round("v", 6))


# A boolean column with nulls is no number column: the default fill is its mode.
@query(
    "fill_boolean",
    """select event_id, case when event_id % 5 = 0 then true else event_id % 5 < 4 end as flag, event_id % 5 = 1 as whole from events""",
)
def fill_boolean(spark, sf):
    k = F.col("event_id") % 5
    df = table(spark, sf, "events").select("event_id", F.when(k != 0, k < 4).alias("flag"), (k == 1).alias("whole"))
    return fill.fill_nulls(df, FillOptions())
