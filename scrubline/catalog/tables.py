"""Table cleaning queries."""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.catalog.texts import sql_strip
from scrubline.operators import dates, outliers, profile
from scrubline.operators import table as T
from scrubline.options import TableOptions
from scrubline.plans.clean_table import clean_table as run_plan


@query("strip_headers", "select n_nationkey, n_name, n_regionkey from nation")
def strip_headers(spark, sf):
    padded = table(spark, sf, "nation").toDF(" n_nationkey", "n_name  ", "\tn_regionkey")
    return T.strip_headers(padded)


PADDED = "concat('  ', c_name, chr(9))"


@query(
    "strip_strings",
    f"""select c_custkey, {sql_strip(PADDED)} as c_name, {sql_strip("c_mktsegment")} as c_mktsegment from customer""",
)
def strip_strings(spark, sf):
    return T.strip_strings(
        table(spark, sf, "customer").select("c_custkey", F.expr(PADDED).alias("c_name"), "c_mktsegment")
    )


@query("lowercase_text", "select p_partkey, lower(p_name) as p_name, lower(p_brand) as p_brand, lower(p_type) as p_type, p_size from part")
def lowercase_text(spark, sf):
    return T.lowercase_text(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query("drop_column", "select o_orderkey, o_custkey, o_totalprice from orders")
def drop_column(spark, sf):
    return T.drop_column(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("preview", "select event_id, user_id, event_type, value from events order by event_id limit 10")
def preview(spark, sf):
    return T.preview(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "event_id")


def text_dates(spark, sf):
    d = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d"), F.date_format("o_orderdate", "yyyyMMdd").alias("iso"))


@query(
    "convert_dates",
    """with t as (select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%d/%m/%Y') end as d,
      strftime(o_orderdate, '%Y%m%d') as iso from orders),
    v as (select count(try_strptime(d, '%d/%m/%Y')) > 0.5 * count(*) as ok,
      count(try_strptime(iso, '%Y%m%d')) > 0.5 * count(*) as ok_iso from t)
    select o_orderkey,
      case when ok then strftime(try_strptime(d, '%d/%m/%Y'), '%Y-%m-%d') else d end as d,
      case when ok_iso then strftime(try_strptime(iso, '%Y%m%d'), '%Y-%m-%d') else iso end as iso,
      ok::int + ok_iso::int as n_converted from t, v""",
)
def convert_dates(spark, sf):
    df, found = dates.convert_dates(text_dates(spark, sf), "o_orderkey", date_order="global")
    return df.select(
        "o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) if c in found else c for c in ("d", "iso")],
        F.lit(len(found)).alias("n_converted"),
    )


DATE_FORMS = {
    # layout of the text, and how DuckDB gives what must be read back
    "zoned": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "strftime(t - to_hours(2), '%Y-%m-%d %H:%M:%S')"),
    "short_year": ("MM/dd/yy", "strftime(t, '%Y-%m-%d 00:00:00')"),
    "clock": ("MM/dd/yyyy hh:mm a", "strftime(t, '%Y-%m-%d %H:%M:00')"),
    "clock_seconds": ("d MMM yyyy h:mm:ss a", "strftime(t, '%Y-%m-%d %H:%M:%S')"),
    "month_year": ("MMM yyyy", "strftime(t, '%Y-%m-01 00:00:00')"),
    "dashed": ("MM-dd-yyyy HH:mm", "strftime(t, '%Y-%m-%d %H:%M:00')"),
    "dotted": ("MM.dd.yyyy HH:mm:ss", "strftime(t, '%Y-%m-%d %H:%M:%S')"),
    "weekday": ("EEEE, MMMM d, yyyy", "strftime(t, '%Y-%m-%d 00:00:00')"),
}


@query(
    "convert_date_forms",
    f"""select o_orderkey, {', '.join(f'{sql} as {c}' for c, (_, sql) in DATE_FORMS.items())}
      from (select o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) + to_seconds(o_orderkey % 60) as t from orders)""",
)
def convert_date_forms(spark, sf):
    """A column for each way of writing a date; every one is found and read."""
    t = F.expr("o_orderdate + make_dt_interval(0, 0, o_orderkey % 1440, o_orderkey % 60)")
    texts = table(spark, sf, "orders").select("o_orderkey", *[F.date_format(t, f).alias(c) for c, (f, _) in DATE_FORMS.items()])
    df, found = dates.convert_dates(texts, "o_orderkey")
    return df.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in found else c for c in DATE_FORMS])


@query(
    "drop_duplicates",
    "select distinct text, lang, source from documents",
)
def drop_duplicates(spark, sf):
    return T.drop_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


@query(
    "drop_duplicates_keep_first",
    "select min(doc_id) as doc_id, text, lang from documents group by text, lang",
)
def drop_duplicates_keep_first(spark, sf):
    return T.drop_duplicates(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


GAPPY = """(select event_id, user_id, case when event_id % 7 = 0 then null else value end as v,
  value * value as w, event_id % 97 as m from events)"""


def _chain(columns, stats, keep) -> str:
    ctes, last = [], GAPPY
    for i, c in enumerate(columns):
        ctes.append(f"s{i} as materialized (select {stats.format(c=c)} from {last} as x{i})")
        ctes.append(f"t{i} as materialized (select x.* from {last} as x, s{i} where {keep.format(c=c)})")
        last = f"t{i}"
    return f"with {', '.join(ctes)} select event_id, v, round(w, 4) as w, m from {last}"


def gappy(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
        (F.col("value") * F.col("value")).alias("w"), (F.col("event_id") % 97).alias("m"),
    )


@query(
    "outliers_zscore",
    _chain(["v", "w", "m"], "avg({c}) as a, stddev_samp({c}) as s", "not coalesce(s > 0, false) or abs(({c} - a) / s) < 2.5"),
)
def outliers_zscore(spark, sf):
    kept = outliers.remove_outliers_zscore(gappy(spark, sf), ["v", "w", "m"], 2.5)
    return kept.select("event_id", "v", F.round("w", 4).alias("w"), "m")


@query(
    "outliers_iqr",
    _chain(
        ["v", "w", "m"], "quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b",
        "not coalesce(b - a > 0, false) or ({c} >= a - 1.5 * (b - a) and {c} <= b + 1.5 * (b - a))",
    ),
)
def outliers_iqr(spark, sf):
    kept = outliers.remove_outliers_iqr(gappy(spark, sf), ["v", "w", "m"])
    return kept.select("event_id", "v", F.round("w", 4).alias("w"), "m")


RAW = """(select event_id, '  ' || event_type || chr(9) as kind, strftime(ts, '%d/%m/%Y') as day,
   case when event_id % 7 = 0 then null else value end as v, user_id % 5 as u from events
 union all select event_id, '  ' || event_type || chr(9), strftime(ts, '%d/%m/%Y'),
   case when event_id % 7 = 0 then null else value end, user_id % 5 from events)"""

CLEAN_TABLE_SQL = f"""with c as materialized (select distinct event_id, lower(trim(kind, ' ' || chr(9))) as kind,
    try_strptime(day, '%d/%m/%Y') as day, v, u from {RAW}),
  s0 as materialized (select avg(v) as a, stddev_samp(v) as s from c),
  t0 as materialized (select c.* from c, s0 where abs((v - a) / s) < 3),
  s1 as materialized (select avg(u) as a, stddev_samp(u) as s from t0),
  t1 as materialized (select t0.* from t0, s1 where abs((u - a) / s) < 3)
  select event_id, kind, strftime(day, '%Y-%m-%d') as day, v, u from t1"""


def raw_events(spark, sf):
    one = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("  "), "event_type", F.lit("\t")).alias(" kind "),
        F.date_format("ts", "dd/MM/yyyy").alias("day"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), (F.col("user_id") % 5).alias("u"),
    )
    return one.union(one)


def _keyed_plan(spark, sf):
    """``event_id`` repeats in the doubled table, so copies agree on it as well."""
    options = TableOptions(date_order="global", lowercase_text=True, remove_outliers=True)
    raw = raw_events(spark, sf).withColumn("row_key", F.col("event_id"))
    return run_plan(raw, options, "row_key")


@query(
    "clean_table",
    CLEAN_TABLE_SQL.replace("s0 as", "e0 as materialized (select avg(event_id) as a, stddev_samp(event_id) as s from c), s0 as"),
)
def clean_table(spark, sf):
    return _keyed_plan(spark, sf)[0].select("event_id", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "v", "u")


@query(
    "clean_table_report",
    f"""with n as (select (select count(*) from {RAW}) as raw, (select count(*) from (select distinct * from {RAW})) as left_,
      (select count(*) from ({CLEAN_TABLE_SQL})) as final)
    select 1 as step_no, '✓ Stripped whitespace from column headers' as step, null::bigint as rows_affected
    union all select 2, '✓ Stripped whitespace from 2 string column(s)', null
    union all select 3, '✓ Converted 1 column(s) to datetime: day (DayFirst=True)', null
    union all select 4, '✓ Converted text to lowercase in 1 column(s)', null
    union all select 5, '✓ Removed ' || (raw - left_) || ' duplicate row(s)', raw - left_ from n
    union all select 6, '✓ Removed ' || (left_ - final) || ' outlier(s) using Z_SCORE', left_ - final from n""",
)
def clean_table_report(spark, sf):
    return _keyed_plan(spark, sf)[1]


@query(
    "shape_compare",
    """select 'before' as version, count(*) as row_count, 4::bigint as column_count, 'doc_id, text, lang, source' as columns from documents
    union all select 'after', count(*), 3, 'text, lang, source' from (select distinct text, lang, source from documents)""",
)
def shape_compare(spark, sf):
    before = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return profile.shape_compare(before, T.drop_duplicates(before.drop("doc_id")))
