"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Seeds are the spans of the base patterns and long hexadecimal secrets. Identifier-shaped
mentions of the whole corpus are linked to the lexical patterns around them (the words on
the left, the words on the right, both). Iteratively, a pattern is as good as the share
of its mentions that are believed identifiers, and a mention's value is believed if good
patterns hold it, until the good patterns no longer change. Secrets and all values believed
at the end are spans wherever they stand. All of it is joins, groupings and built-in
functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import hot_keys, join_hot, join_split, stored

#: Patterns need this confidence, and this many different believed values.
CONFIDENCE, SUPPORT = 0.8, 3
#: Added to the mentions of a pattern that are not believed, so that rare patterns stay low.
DOUBT = 0.5
SALTS = 16
BLOCK = 256
#: The base kinds in the order of ties. Possessive repeats keep long runs linear; a match may
#: begin where the run begins or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?<=[0-9])"
#: Shape of a mention: a run without space, quotes or brackets that holds a digit or an ``@``,
#: of six characters or more, with marks at its end left out. A run is taken whole, however
#: long; possessive repeats keep that linear.
_RUN, _MARKS = r"\s\"'<>()\[\]{},;=", r".:!?#*$%&|"
MENTION = (
    rf"(?<![^{_RUN}])(?=[^{_RUN}@0-9]*+[@0-9])(?=[^{_RUN}]{{5}}[{_MARKS}]*+[^{_RUN}{_MARKS}])"
    rf"(?:[{_MARKS}]*+[^{_RUN}{_MARKS}]++)++"
)
SECRET = r"^[0-9a-fA-F]{32,}$"
#: Words of the context, taken whole; a pattern longer than this is named by its digest.
_WORD, LONG = r"[^\s\"']++", 200
_FIRST = r"(?<![^\s\"'])"
REDACTED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "id": "[ID]"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _largest(numbers: Column) -> Column:
    return F.coalesce(F.array_max(numbers), F.lit(0))


def running(numbers: Column, fold: Callable[[Column], Column] = _total, join: Callable = lambda a, b: a + b) -> Column:
    """``out[i]``: the fold of the first ``i`` numbers, for i below the length. Whole blocks
    are folded once, so thousands of numbers stay cheap."""
    n = F.size(numbers)
    whole = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: fold(
        F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(_let(whole, lambda w: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: join(
            fold(F.slice(w, F.lit(1), block(i))), fold(F.slice(numbers, block(i) * BLOCK + 1, i % BLOCK))))))


def found(text: Column, pattern: str) -> Column:
    """``array<struct<start, value, before, after>>`` of the leftmost matches that do not
    overlap; start in code points, before and after the text up to the neighbouring match."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(gaps: Column, values: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))
        return _let(_let(steps, lambda x: running(x)), lambda before: F.transform(values, lambda v, i: F.struct(
            (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"), v.alias("value"),
            F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))))

    return _let(F.struct(gaps.alias("g"), values.alias("v")), lambda x: spans(x["g"], x["v"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _kind(name: str, rank: int, text: Column, pattern: str, needs: Column, holds: Callable[[Column], Column]) -> Column:
    spans = F.transform(F.filter(found(text, pattern), lambda m: holds(m["value"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"),
        F.lit(name).alias("kind")))
    return F.when(needs, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def base_spans(text: Column) -> Column:
    """``array<struct<start, rank, end, kind>>`` of the base kinds, by start, then kind."""
    digit = text.rlike("[0-9]")
    address = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
    return F.sort_array(F.concat(
        _kind("email", 0, text, EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        _kind("ip", 1, text, IP, digit, lambda v: v.rlike(address)),
        _kind("card", 2, text, CARD, digit, lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))),
        _kind("phone", 3, text, PHONE, digit & F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    ))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: ``(id, h, base, mentions)``. ``h`` is a hash of the text;
    rows with equal id and text are the same document twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    inside = lambda s, m: (s["start"] < m["start"] + F.length(m["value"])) & (m["start"] < s["end"])
    # ``known``: the mention overlaps a base span, or looks like a secret.
    mentions = F.when(F.col("t").rlike("[0-9@]"), F.transform(found(F.col("t"), MENTION), lambda m: F.struct(
        m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), F.lower(m["value"]).alias("value"),
        F.regexp_extract(m["before"], rf"(?:{_FIRST}{_WORD})?(?<!\s|[\"'])[\s\"']*+\z", 0).alias("l1"),
        F.regexp_extract(m["before"], rf"{_FIRST}{_WORD}\s++{_WORD}[\s\"']*+\z", 0).alias("l2"),
        F.regexp_extract(m["after"], rf"\A[\"']?[.:!?#*$%&|,;]*+\s*+(?:{_WORD})?", 0).alias("r1"),
        (F.exists("base", lambda s: inside(s, m))).alias("base"), m["value"].rlike(SECRET).alias("secret"),
    ))).otherwise(F.array())
    return rows.withColumn("base", base_spans(F.col("t"))).select("id", F.xxhash64("t").alias("h"), "base", mentions.alias("mentions"))


def _patterns(m: str = "m") -> Column:
    """The patterns a mention stands in. One with an empty side says nothing and is left out."""
    side = lambda c: F.regexp_replace(F.lower(F.col(f"{m}.{c}")), r"\s+", " ")
    left, more, right = side("l1"), side("l2"), side("r1")
    named = lambda p: F.when(F.length(p) > LONG, F.sha2(p.cast("binary"), 256)).otherwise(p)
    return F.array_compact(F.array(
        F.when(F.trim(more) != "", named(F.concat(more, F.lit("_")))),
        F.when((F.trim(left) != "") & (F.trim(right) != ""), named(F.concat(left, F.lit("_"), right))),
    ))


def _scored(edges: DataFrame, believed: DataFrame, hot: list[tuple]) -> DataFrame:
    """Confidence of every pattern, given the belief in values. Partial sums come first, so
    a pattern in very many texts is small before the shuffle; a value in very many patterns
    is split."""
    held = join_split(edges, believed, ["value"], hot, F.xxhash64("pattern"), how="left").withColumn("b", F.coalesce("belief", F.lit(0.0)))
    return held.groupBy("pattern").agg(
        (F.sum("b") / (F.count(F.lit(1)) + DOUBT)).alias("confidence"), F.sum((F.col("b") >= 0.5).cast("int")).alias("support")
    ).where(F.col("support") >= SUPPORT)


def believed_values(edges: DataFrame, seeds: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``(value, belief)`` when the patterns above the threshold no longer change.

    ``edges (pattern, value)`` are distinct pairs, ``seeds (value)`` believed fully and for
    good. Another value is believed by the chance that not all of its patterns that are
    above the threshold err. Belief spreads over one pattern and its values each round;
    it only grows, so the good patterns do too, and there is a last round.
    """
    hot = hot_keys(edges.groupBy("value").agg(F.count(F.lit(1)).alias("n")), ["value"], "n")
    sure = seeds.select("value", F.lit(1.0).alias("belief"))
    believed, before = sure, None
    while True:
        good = stored(_scored(edges, believed, hot).where(F.col("confidence") >= confidence), "patterns")
        state = good.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern").cast("decimal(38,0)"))).first()
        spread = good.select("pattern", "confidence", F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
        salted = edges.withColumn("salt", F.expr(f"cast(pmod(xxhash64(value), {SALTS}) as int)"))
        learned = salted.join(spread, ["pattern", "salt"]).groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("belief"))
        believed = sure.unionByName(learned).groupBy("value").agg(F.max("belief").alias("belief"))
        if state == before:
            return believed
        before = state


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, h, base, spans)`` for every row of ``docs``: ``base`` the spans of the base
    kinds, ``spans`` those and the ones of kind ``id`` that the method adds, each a
    ``struct<start, rank, end, kind>`` in order of start, then kind.

    Added are the mentions, wherever they stand, that look like a secret or whose value
    (lower-cased) is believed at the end. Null and empty texts have none. A mention that
    overlaps a base span adds nothing. Repeated rows get equal results; null ids are kept;
    an empty table gives an empty result; further columns are not read. ``h`` is
    ``xxhash64`` of the text (null: empty).
    """
    rows = stored(_scanned(docs, id_col, text_col), "scanned")
    mentions = stored(rows.select("id", "h", F.explode("mentions").alias("m")).select(
        "id", "h", "m.start", "m.end", "m.value", (F.col("m.base") | F.col("m.secret")).alias("seed"),
        F.col("m.base").alias("inside"), "m.secret", _patterns().alias("patterns")), "mentions")
    edges = stored(mentions.select(F.explode("patterns").alias("pattern"), "value").distinct(), "graph")
    believed = believed_values(edges, mentions.where("seed").select("value").distinct())

    span = F.struct("start", F.lit(4).alias("rank"), "end", F.lit("id").alias("kind")).alias("span")
    fresh = mentions.where("not inside and not secret").select("id", "h", "value", span)
    counts = stored(fresh.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    known = stored(believed.where(F.col("belief") >= CONFIDENCE).join(counts, "value"), "believed")
    told = join_hot(fresh, known, "value", "n", "h").select("id", "h", "span")
    secrets = mentions.where("secret and not inside").select("id", "h", span)
    added = told.union(secrets).groupBy("id", "h").agg(F.collect_set("span").alias("added"))
    keyed = added.select(F.col("id").alias("a_id"), F.col("h").alias("a_h"), "added")
    return rows.select("id", "h", "base").join(keyed, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")), "left").select(
        F.col("id").alias(id_col), "h", "base",
        F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs`` with every span replaced by its kind; overlapping spans become one, named
    after the first. A null text stays null. All columns and rows are kept; ``length_col``,
    if given, is set to the new length of a text that was changed.

    Only texts with a digit or an ``@`` can hold a span; the others are not joined.
    """
    marks = spans(docs, id_col, text_col).where(F.size("spans") > 0).groupBy(
        F.col(id_col).alias("_p_id"), F.col("h").alias("_p_h")).agg(F.first("spans").alias("_p_spans"))
    may = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    keyed = docs.where(may).join(
        marks, F.col(id_col).eqNullSafe(F.col("_p_id")) & (F.xxhash64(text_col) == F.col("_p_h")), "left")
    names = F.create_map(*[F.lit(x) for pair in REDACTED.items() for x in pair])
    # The furthest end before each span; a span that starts at or after it begins a new stretch.
    reach = _let(F.transform("_p_spans", lambda s: s["end"]), lambda e: running(e, _largest, F.greatest))
    marked = _let(reach, lambda r: F.filter(F.transform("_p_spans", lambda s, i: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), F.get(r, i).alias("before"))), lambda x: x["start"] >= x["before"]))
    text = F.col(text_col)
    last = F.array_max(F.transform("_p_spans", lambda s: s["end"]))
    new = _let(marked, lambda m: F.concat(
        F.array_join(F.transform(m, lambda x: F.concat(
            F.substring(text, x["before"] + 1, x["start"] - x["before"]), names[x["kind"]])), ""),
        F.substring(text, last + 1, F.length(text))))
    changed = F.when(F.col("_p_spans").isNull(), text).otherwise(new)
    done = keyed.withColumn("_p_text", changed)
    columns = [
        F.col("_p_text").alias(c) if c == text_col
        else F.when(F.col("_p_spans").isNull(), F.col(f"`{c}`")).otherwise(F.length("_p_text")).alias(c) if c == length_col
        else F.col(f"`{c}`") for c in docs.columns
    ]
    return done.select(*columns).unionAll(docs.where(~may))
