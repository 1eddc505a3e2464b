"""Profiling queries."""

from pyspark.sql import functions as F

from scrubline.catalog.fills import gappy_events
from scrubline.catalog.registry import query, table
from scrubline.functions import fixed_values as V
from scrubline.operators import profile as P

GAPPY = """(select event_id, user_id, case when event_id % 7 = 0 then null else value end as v,
  case when event_id % 5 = 0 then null else event_type end as c from events)"""
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("table_size", "select count(*) as row_count, 11::bigint as column_count from lineitem")
def table_size(spark, sf):
    return P.table_size(table(spark, sf, "lineitem"))


def _id_sql(name: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select {i + 1} as position, '{c}' as \"column\" from {name} having count(distinct {c}) = count(*)"
        for i, c in enumerate(columns)
    )


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("id_columns", _id_sql("orders", ORDER_COLUMNS))
def id_columns(spark, sf):
    return P.id_columns(table(spark, sf, "orders").select(*ORDER_COLUMNS))


@query(
    "null_summary",
    f"""select 'v' as "column", count(*) - count(v) as null_count, round_even((count(*) - count(v)) * 100.0::double / count(*), 2) as percentage from {GAPPY}
    union all select 'c', count(*) - count(c), round_even((count(*) - count(c)) * 100.0::double / count(*), 2) from {GAPPY}""",
)
def null_summary(spark, sf):
    return P.null_summary(gappy_events(spark, sf))


@query(
    "remaining_nulls",
    f"select 2 * count(*) - count(v) - count(c) as remaining_nulls from {GAPPY}",
)
def remaining_nulls(spark, sf):
    return P.remaining_nulls(gappy_events(spark, sf))


@query(
    "top_categories",
    "select p_name as category, count(*) as n from part group by 1 order by n desc, category limit 10",
)
def top_categories(spark, sf):
    return P.top_categories(table(spark, sf, "part"), "p_name")


@query(
    "top_share",
    f"""select c as category, count(*) as n, round(count(*) * 100.0 / (select count(*) from {GAPPY}), 1)::double as percent
    from {GAPPY} where c is not null group by c order by n desc, c limit 1""",
)
def top_share(spark, sf):
    return P.top_share(gappy_events(spark, sf), "c")


@query(
    "numeric_stats",
    " union all ".join(
        f"""select '{c}' as "column", round(avg({c}), 4) as mean, quantile_cont({c}, 0.5) as median,
        round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max from lineitem"""
        for c in LINE
    ),
)
def numeric_stats(spark, sf):
    stats = P.numeric_stats(table(spark, sf, "lineitem"), LINE)
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


# The bin rule (steps of 1, 2, 5 times a power of ten) spelled in SQL.
@query(
    "histogram",
    f"""with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
    s0 as (select *, 10.0 ** (round(log10(hi - lo)) - 2) as s from e),
    s1 as (select *, case when ceil((hi - lo) / s) > {V.HISTOGRAM_BINS} then s * 10 else s end as t from s0),
    s2 as (select *, case when (hi - lo) / (t / 5) <= {V.HISTOGRAM_BINS} then t / 5 else t end as u from s1),
    s3 as (select *, case when (hi - lo) / (u / 2) <= {V.HISTOGRAM_BINS} then u / 2 else u end as step from s2),
    b as (select floor(lo / step) * step as start, ceil(hi / step) * step as stop, step from s3)
    select start + k * step as bin_start, start + (k + 1) * step as bin_end, count(*) as n
    from (select start, step, least(floor((o_totalprice - start) / step), round((stop - start) / step) - 1) as k from orders, b)
    group by start, step, k""",
)
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice")


@query(
    "correlation",
    " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, round({'1.0::double' if a == b else f'corr({a}, {b})'}, 6) as correlation"
        + ("" if a == b else " from lineitem")
        for a in LINE
        for b in LINE
    ),
)
def correlation(spark, sf):
    return P.correlation(table(spark, sf, "lineitem"), LINE).withColumn("correlation", F.round("correlation", 6))


@query(
    "mode",
    " union all ".join(
        f"""(select '{c}' as "column", {c}::varchar as mode, count(*) as n from part group by {c} order by n desc, part.{c} limit 1)"""
        for c in ("p_size", "p_brand", "p_type", "p_name")
    ),
)
def mode(spark, sf):
    return P.mode_table(table(spark, sf, "part"), ["p_size", "p_brand", "p_type", "p_name"])
