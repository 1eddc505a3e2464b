"""Text queries."""

from pyspark.sql import functions as F

from scrubline.catalog.registry import query, table
from scrubline.functions import text as X
from scrubline.operators import text_tables as TT
from scrubline.options import TextOptions
from scrubline.plans import clean_text as plan
from scrubline.plans.materialize import scratch_path
from scrubline.plans.parallel import spread
from scrubline.streaming.incremental import clean_text_stream, text_stream

# whitespace class and cased letters, spelled for RE2
W = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
C = r"\p{Lu}\p{Ll}\p{Lt}"

MESSY = """concat('  ', replace(text, '. ', concat('.  ', chr(10), chr(10), chr(9), ' ')),
  ' x http://a.io/', cast(doc_id as string), '?q=1#f ', '😀', ' a', chr(13), chr(10), 'b ')"""
GAPPED = "replace(text, '. ', concat('. ', chr(10), chr(10), chr(10), chr(10)))"


def sub(column: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def sql_strip(c: str) -> str:
    return sub(c, rf"\A[{W}]+|[{W}]+\z")


def sql_spaces(c: str) -> str:
    return sql_strip(sub(sub(c, " +", " "), rf"(?m)^[{W}]+|[{W}]+$"))


def sql_linebreaks(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_escapes(c: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), "
        f"chr(0), ''), chr(12), chr(10)), chr(11), chr(10))"
    )


def sql_spec_spaces(c: str) -> str:
    return sub(c, r"[\t\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " ")


def sql_title(c: str) -> str:
    runs = f"regexp_extract_all({c}, '[{C}]+|[^{C}]+')"
    return f"array_to_string(list_transform({runs}, lambda x: case x[1] when 'ß' then 'Ss' else upper(x[1]) end || lower(x[2:])), '')"


def sql_stats(c: str, prefix: str = "") -> str:
    end = r"\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    body = f"regexp_replace({c}, '(?:{end})\\z', '')"
    return f"""length({c}) as {prefix}chars,
      len(list_filter(string_split_regex({c}, '[{W}]+'), lambda x: x <> '')) as {prefix}words,
      case when {c} = '' then 0 else len(string_split_regex({body}, '{end}')) end as {prefix}lines,
      length({c}) - length({sub(c, '[.!?]')}) as {prefix}sentences"""


BASIC = rf"[^a-zA-Z0-9{W}.,!?;:\-'\"]"
STRICT = rf"[^a-zA-Z0-9{W}]"
EMAIL = rf"[^{W}]+@[^{W}]+\.[^{W}]+"
PHONE = rf"((\+?\p{{Nd}}{{1,3}}[-.{W}]?)?(\(?\p{{Nd}}{{3}}\)?[-.{W}]?)?\p{{Nd}}{{3}}[-.{W}]?\p{{Nd}}{{4}})"
ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def sql_unescape(c: str) -> str:
    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def documents(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id")


def pages(spark, sf):
    return spread(table(spark, sf, "pages"), "page_id")


def docs(spark, sf, expr: str = "text"):
    return documents(spark, sf).select("doc_id", F.expr(expr).alias("t"))


def mapped(name: str, expr: str, sql: str, f):
    """A text function over every document, its input built by ``expr`` in both engines."""
    query(name, f"select doc_id, {sql.format(t='t')} as t from (select doc_id, {expr} as t from documents)")(
        lambda spark, sf: docs(spark, sf, expr).select("doc_id", f(F.col("t")).alias("t"))
    )


def plain(s: str) -> str:
    return s.replace("{", "{{").replace("}", "}}").replace("@T@", "{t}")


mapped("remove_urls", MESSY, plain(sub("@T@", r"https?://[!$-_a-z]+")), X.remove_urls)
mapped("remove_emails", "text", plain(sub("@T@", EMAIL)), X.remove_emails)
mapped("remove_phones", "text", plain(sub("@T@", PHONE)), X.remove_phone_numbers)
mapped("remove_emojis", MESSY, plain(sub("@T@", r"[\x{10000}-\x{10FFFF}]")), X.remove_emojis)
mapped("special_keep_basic", "text", plain(sub("@T@", BASIC)), X.remove_special_characters)
mapped("special_strict", "text", plain(sub("@T@", STRICT)), lambda c: X.remove_special_characters(c, False))
mapped("case_lower", "text", "lower({t})", X.normalize_case)
mapped("case_upper", "text", "upper(replace({t}, 'ß', 'SS'))", lambda c: X.normalize_case(c, "uppercase"))
mapped("case_title", "text", plain(sql_title("@T@")), lambda c: X.normalize_case(c, "title"))
mapped("remove_spaces", MESSY, plain(sql_spaces("@T@")), X.remove_extra_spaces)
mapped("remove_linebreaks", GAPPED, plain(sql_linebreaks("@T@")), X.remove_extra_linebreaks)
mapped("special_spaces", MESSY, plain(sql_spec_spaces("@T@")), X.replace_special_whitespace)
mapped("escape_chars", MESSY, plain(sql_escapes("@T@")), X.replace_escape_characters)
mapped("text_preview", "text", "substring({t}, 1, 1000)", X.preview)


@query("html_unescape", f"select page_id, {sql_unescape('html')} as t from pages")
def html_unescape(spark, sf):
    return pages(spark, sf).select("page_id", X.html_unescape(F.col("html")).alias("t"))


@query("strip_html", f"select page_id, {sub(sql_unescape('html'), '<[^>]+>')} as t from pages")
def strip_html(spark, sf):
    return pages(spark, sf).select("page_id", X.strip_html(F.col("html")).alias("t"))


@query("text_stats", f"select doc_id, {sql_stats('t')} from (select doc_id, {MESSY} as t from documents)")
def text_stats(spark, sf):
    return docs(spark, sf, MESSY).select("doc_id", X.text_stats(F.col("t")).alias("s")).select("doc_id", "s.*")


SIMPLE = sql_linebreaks(sql_spaces(f"lower({sub('text', BASIC)})"))


@query(
    "language_stats",
    f"""select lang, count(*) as n_docs, sum(chars)::bigint as chars, sum(words)::bigint as words,
      sum(lines)::bigint as lines, sum(sentences)::bigint as sentences, round(avg(words), 6) as avg_words
    from (select lang, {sql_stats('t')} from (select lang, {SIMPLE} as t from documents)) group by lang""",
)
def language_stats(spark, sf):
    """Flagship: clean every document and profile the result by language."""
    t = F.col("text")
    for f in (X.remove_special_characters, X.normalize_case, X.remove_extra_spaces, X.remove_extra_linebreaks):
        t = f(t)
    stats = documents(spark, sf).select("lang", t.alias("t")).select("lang", X.text_stats(F.col("t")).alias("s"))
    return stats.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(f"s.{m}").alias(m) for m in TT.METRICS],
        F.round(F.avg("s.words"), 6).alias("avg_words"),
    )


def sql_clean(c: str) -> str:
    """The default text plan."""
    c = sub(sql_unescape(c), "<[^>]+>")
    return sql_linebreaks(sql_spaces(sql_title(sql_escapes(sql_spec_spaces(sub(c, BASIC))))))


LABELS = [label for label, _ in plan.text_steps(TextOptions())]
CLEANED = f"select page_id, html, {sql_clean('html')} as cleaned_text from pages"


@query(
    "clean_text",
    f"""select page_id, cleaned_text, {sql_stats('cleaned_text')}, '{'|'.join(LABELS)}' as steps from ({CLEANED})""",
)
def clean_text(spark, sf):
    cleaned = plan.clean_text(pages(spark, sf), "html")
    return cleaned.select("page_id", "cleaned_text", "final_stats.*", F.array_join("steps", "|").alias("steps"))


ALL_ON = TextOptions(
    remove_urls=True, remove_emails=True, remove_phone=True, remove_emojis=True, keep_basic_punctuation=False,
    case_mode="lowercase",
)


def sql_clean_all(c: str) -> str:
    c = sub(sql_unescape(c), "<[^>]+>")
    for p in (r"https?://[!$-_a-z]+", EMAIL, PHONE, r"[\x{10000}-\x{10FFFF}]", STRICT):
        c = sub(c, p)
    return sql_linebreaks(sql_spaces(f"lower({sql_escapes(sql_spec_spaces(c))})"))


@query(
    "clean_text_all_steps",
    f"select doc_id, {sql_clean_all('t')} as cleaned_text from (select doc_id, {MESSY} as t from documents)",
)
def clean_text_all_steps(spark, sf):
    return plan.clean_text(docs(spark, sf, MESSY), "t", ALL_ON).select("doc_id", "cleaned_text")


@query(
    "clean_text_stream",
    f"select doc_id, {sql_clean_all('t')} as cleaned_text from (select doc_id, {MESSY} as t from documents)",
)
def clean_arriving_text(spark, sf):
    """The same steps on files as they arrive: two batches, each cleaned once."""
    source, target, state = (scratch_path(spark, n) for n in ("arriving", "cleaned", "offsets"))
    texts = docs(spark, sf, MESSY).withColumnRenamed("t", "text")
    for part in (0, 1):
        texts.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(source)
        clean_text_stream(text_stream(spark, source), target, state, ALL_ON).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "cleaned_text")


def _report_sql() -> str:
    steps = [
        sub(sql_unescape("@"), "<[^>]+>"), sub("@", BASIC), "@", sql_spec_spaces("@"), sql_escapes("@"),
        sql_title("@"), sql_spaces("@"), sql_linebreaks("@"),
    ]
    chain = "select html as t0 from pages"
    for i, s in enumerate(steps):
        chain = f"select *, {s.replace('@', f't{i}')} as t{i + 1} from ({chain})"
    rows = " union all ".join(
        f"select {i + 1} as step_no, '{label}' as step, count(*) filter (t{i} <> t{i + 1}) as rows_changed from c"
        for i, label in enumerate(LABELS)
    )
    return f"with c as materialized ({chain}) {rows}"


@query("text_report", _report_sql())
def text_report(spark, sf):
    return plan.text_report(pages(spark, sf), "html")


@query(
    "text_result_json",
    f"""select page_id, cleaned_text, {sql_stats('cleaned_text')}, {len(LABELS)} as n_steps from ({CLEANED})""",
)
def text_result_json(spark, sf):
    """The JSON result, parsed back: object member order differs between engines."""
    line = plan.clean_text(pages(spark, sf), "html").select("page_id", plan.result_json(None).alias("j"))
    schema = "cleaned_text string, stats struct<chars:long,words:long,lines:long,sentences:long>, steps array<string>"
    return line.select("page_id", F.from_json("j", schema).alias("r")).select(
        "page_id", "r.cleaned_text", "r.stats.*", F.size("r.steps").alias("n_steps")
    )


STATS_SQL = f"""select doc_id, u.metric as metric, u.original as original, u.cleaned as cleaned, u.cleaned - u.original as delta from (
  select doc_id, unnest([
    {{'metric': 'Characters', 'original': o_chars, 'cleaned': c_chars}},
    {{'metric': 'Words', 'original': o_words, 'cleaned': c_words}},
    {{'metric': 'Lines', 'original': o_lines, 'cleaned': c_lines}},
    {{'metric': 'Sentences', 'original': o_sentences, 'cleaned': c_sentences}}]) as u
  from (select doc_id, {sql_stats('o', 'o_')}, {sql_stats('c', 'c_')} from (
    select doc_id, t as o, {sql_spaces('t')} as c from (select doc_id, {MESSY} as t from documents))))"""


def before_after(spark, sf):
    return docs(spark, sf, MESSY).withColumnRenamed("t", "o").withColumn("c", X.remove_extra_spaces(F.col("o")))


@query("stats_compare", STATS_SQL)
def stats_compare(spark, sf):
    return TT.stats_compare(before_after(spark, sf), "doc_id", "o", "c")


@query(
    "unpivot_stats",
    f"""with s as ({STATS_SQL}) select doc_id, metric, 'original' as version, original as "count" from s
    union all select doc_id, metric, 'cleaned', cleaned from s""",
)
def unpivot_stats(spark, sf):
    return TT.unpivot_stats(before_after(spark, sf), "doc_id", "o", "c")


OLD, NEW = "replace(text, '. ', chr(10))", "replace(replace(text, '. ', chr(10)), ' a', ' A')"


@query(
    "line_diff",
    f"""with l as (
      select doc_id, unnest(string_split({OLD}, chr(10))) as line, 1 as a, 0 as b from documents
      union all select doc_id, unnest(string_split({NEW}, chr(10))), 0, 1 from documents),
    n as (select doc_id, line, sum(a)::bigint as a, sum(b)::bigint as b from l group by all),
    s as (select doc_id, line, 'same' as status, least(a, b) as n_lines from n
      union all select doc_id, line, 'removed', a - b from n union all select doc_id, line, 'added', b - a from n)
    select * from s where n_lines > 0""",
)
def line_diff(spark, sf):
    pairs = documents(spark, sf).select("doc_id", F.expr(OLD).alias("o"), F.expr(NEW).alias("n"))
    return TT.line_diff(pairs, "doc_id", "o", "n")


@query(
    "line_script",
    f"""with o as (select doc_id, unnest(range(1, len(l) + 1)) as i, len(l) as n, unnest(l) as line
        from (select doc_id, string_split({OLD}, chr(10)) as l from documents)),
      k as (select *, i || ' ' || line as x, (i % 4 <> 0 and (i > 1 or n < 8)) as kept from o),
      n as (select doc_id, i, 1 as s, x, kept, true as old from k where kept
        union all select doc_id, i, 2, 'new ' || i, true, false from k where i % 5 = 0
        union all select doc_id, n + 1, 3, x, false, true from k where i = 1 and n >= 8),
      p as (select *, row_number() over (partition by doc_id order by i, s) as j from n)
    select doc_id, 'same' as status, x as line, i as before_at, j as after_at from p where s = 1
    union all select doc_id, 'removed', x, i, null from k where not kept
    union all select doc_id, 'added', x, null, j from p where s > 1""",
)
def line_script(spark, sf):
    """Every fourth line goes, a new one comes after every fifth, the first moves to the end."""
    lines = F.transform(F.split(F.expr(OLD), "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    df = table(spark, sf, "documents").select("doc_id", lines.alias("l"))
    new = F.expr("""concat(
        flatten(transform(l, (x, i) -> concat(
          if((i + 1) % 4 <> 0 and (i > 0 or size(l) < 8), array(x), array()),
          if((i + 1) % 5 = 0, array(concat('new ', i + 1)), array())))),
        if(size(l) >= 8, array(l[0]), array()))""")
    texts = df.select("doc_id", F.array_join("l", "\n").alias("o"), F.array_join(new, "\n").alias("n"))
    return TT.line_script(texts, "doc_id", "o", "n").drop("at")


@query(
    "line_script_texts",
    f"""select doc_id, side, md5(t) as digest from (
      select doc_id, 'before' as side, {OLD} as t from documents union all select doc_id, 'after', {NEW} from documents)
    where t <> ''""",
)
def line_script_texts(spark, sf):
    """A script rebuilds both of its texts."""
    pairs = table(spark, sf, "documents").select("doc_id", F.expr(OLD).alias("o"), F.expr(NEW).alias("n"))
    script = TT.line_script(pairs, "doc_id", "o", "n")
    sides = [TT.script_text(script, "doc_id", s).select("doc_id", F.lit(s).alias("side"), F.md5(F.col("text").cast("binary")).alias("digest")) for s in ("before", "after")]
    return sides[0].union(sides[1])


@query(
    "drop_invalid_bytes",
    "select doc_id, text || ' é' as text from documents",
)
def drop_invalid_bytes(spark, sf):
    """Bytes that are no UTF-8, here at both ends of every second text, are dropped."""
    text = F.concat("text", F.lit(" é")).cast("binary")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FF")), text, F.unhex(F.lit("C3")))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", X.decode_dropping_invalid(raw).alias("text"))


@query(
    "concat_documents",
    """select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text
    from conversations where length(text) > 0 group by conv_id""",
)
def concat_documents(spark, sf):
    return TT.concat_documents(table(spark, sf, "conversations"), "conv_id", "turn")


@query(
    "concat_documents_sparse",
    """select lang, string_agg(text, chr(10) || chr(10) order by doc_id) as text
    from documents where length(text) > 0 group by lang""",
)
def concat_documents_sparse(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text", (F.col("doc_id") * 1_000_003).alias("at"))
    return TT.concat_documents(docs, "lang", "at")


@query(
    "ordered_texts",
    """select source, row_number() over (partition by source order by doc_id) as position, text
    from documents where length(text) > 0""",
)
def ordered_texts(spark, sf):
    return TT.ordered_texts(table(spark, sf, "documents"), "source", "doc_id")


LEAVES = """concat('{"kind":"', event_type, '","inner":{"p":', props, ',"list":["', event_type, '",1,{"u":"u', cast(user_id as string), '"},""]}}')"""


@query(
    "json_leaves",
    """select event_id, '$.kind' as path, event_type as value from events
    union all select event_id, '$.inner.list[0]', event_type from events
    union all select event_id, '$.inner.list[2].u', 'u' || user_id from events""",
)
def json_leaves(spark, sf):
    nested = table(spark, sf, "events").select("event_id", F.expr(LEAVES).alias("j"))
    return TT.json_leaves(nested, "event_id", "j")


@query(
    "json_text",
    """select event_id, event_type || chr(10) || event_type || chr(10) || 'u' || user_id as t from events""",
)
def json_text(spark, sf):
    from scrubline.functions.json_text import json_text as to_text

    return table(spark, sf, "events").select("event_id", to_text(F.expr(LEAVES)).alias("t"))
