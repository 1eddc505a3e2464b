"""One query for each operator over its whole table, and the SQL twins that exist.

Fixed parameters of the queries stand here; the operators take them as arguments.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.catalog.registry import Query, table
from scrubline.llm import bpe, decontam, fill_middle, jaccard, lang_cnn, lexical, pii, quality_ordinal, quality_rules, simhash, token_store, url_filter, warc
from scrubline.plans.materialize import scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@_query("op2_token_store")
def op2_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    store = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, folder, "documents"), store, lambda: token_store.library_encoder(path, literal=False))
    return token_store.read_tokens(spark, store)


@_query("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def byte_vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = byte_vocabulary()
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), vocabulary), vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op9_decontamination")
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13, share=20)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@_query("op10_warc")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"), min_bytes=0)
    return warc.read_archives(manifest).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@_query("op4_quality_rules", """
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select doc_id, w, unnest(range(len(w) - 2)) as i from w where len(w) >= 3),
c as (select doc_id, i, count(*) over (partition by doc_id, w[i + 1], w[i + 2], w[i + 3]) as n from g),
p as (select distinct doc_id, i + k as at from c, (select unnest(range(3)) as k) where n > 1),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
m as (select doc_id, len(w) as n_words, coalesce(len(list_aggregate(w, 'string_agg', '')), 0) as word_chars,
      len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      len(text) - len(replace(text, '!', '')) as n_exclamations,
      len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
      len(list_filter(w, lambda x: list_contains([{stop}], lower(regexp_extract(x, '^\\p{{P}}*(.*?)\\p{{P}}*$', 1))))) as n_stop_words,
      len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*\\x{{2022}}]'))) as bullets,
      len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09-\\x0D]*$'))) as ellipses from w),
b as (select m.*, coalesce(n_repeat_words, 0) as n_repeat_words from m left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2.0 * n_words and 14.0 * n_words and n_symbols <= 0.25 * n_words
  and n_exclamations <= 0.3 * n_words and n_stop_words >= 0.01 * n_words and n_dup_lines <= 0.3 * n_lines
  and bullets <= 0.9 * n_lines and ellipses <= 0.3 * n_lines as kept
from f
""".format(stop=", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)))
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The contract's rules.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
]


@_query("op7_url_filter", """
with r(rule, verdict) as (values {rules}),
h as (select *, regexp_extract(rule, '^[^/]*') as r_host, regexp_extract(rule, '^[^/]*(.*)$', 1) as r_path from r),
s as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from s),
m as (select host, path, arg_max(rule, len(rule)) as rule, arg_max(verdict, len(rule)) as verdict
      from (select distinct host, path from p) join h on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
      group by host, path)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict
from p left join m on p.host = m.host and p.path = m.path
""".format(rules=", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)))
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.rules_of(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@_query("op8_lang_cnn")
def op8_lang_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = lang_cnn.held_out()
    net = lang_cnn.train(docs.where(~out))
    return lang_cnn.predicted(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: The grade of documents that are good and not toxic.
CLEAN_GRADE = 2


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality_ordinal.Model:
    return quality_ordinal.train(docs, quality_ordinal.grades_of(table(spark, folder, "labels")), n_grades=3)


@_query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality_ordinal.judged(docs, quality_model(spark, docs, folder), min_grade=1)
    # ``selected`` is on quality alone; ``clean`` leaves out what is good but toxic, as the pipeline does.
    return found.withColumn("clean", F.get("tails", F.lit(CLEAN_GRADE - 1)) >= 0.5)


@_query("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.spans(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@_query("op11_jaccard_join")
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"), shingle=3, percent=90)


@_query("op12_fill_middle", """
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
      regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u from documents),
d as (select doc_id, text, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
      ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from d),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf,
      case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
      from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
  case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from p
""")
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, folder, "documents"), unit="token", rate=50, spm=80, seed=42)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@_query("op13_lexical_search", """
with t as (select doc_id, row_number() over () as r, unnest(regexp_extract_all(coalesce(text, ''), '{term}')) as x from documents),
w as (select doc_id, r, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from t),
p as (select doc_id, r, w, count(*) as tf from w group by all),
n as (select r, sum(tf)::bigint as n from p group by r),
c as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from n),
f as (select w, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from p, c group by w, big_n),
q as (select item_id, text, unnest(regexp_extract_all(coalesce(text, ''), '{term}')) as x from (select distinct item_id, text from benchmark)),
i as (select item_id, text, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as times from q group by all),
s as (select item_id, text, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
      from i join f using (w) join p using (w) join n using (r), c group by item_id, text, doc_id, r),
k as (select *, row_number() over (partition by item_id, text order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
""".format(term=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.build(table(spark, folder, "documents"))
    return lexical.search(index, table(spark, folder, "benchmark"), k=10)
