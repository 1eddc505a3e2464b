"""Text functions, ``Column -> Column``.

All are stateless built-in expressions (the entity decoder excepted), so a chain
of them is one projection and works on batch and streaming frames alike.
"""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scrubline.functions import fixed_values as V

CASE_MODES = ("lowercase", "uppercase", "title")


def as_text(c: Column) -> Column:
    """Any value as a string; null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode whitespace (a plain ``trim`` drops spaces only)."""
    return F.trim(c, F.lit(V.WS_CHARS))


@F.arrow_udf(ArrayType(StringType()))
def _unescape(entities: pa.Array) -> pa.Array:
    words = entities.flatten().dictionary_encode()
    decoded = pa.array([html.unescape(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = np.concatenate([[0], np.cumsum(entities.value_lengths().to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), decoded.take(words.indices))


def html_unescape(c: Column) -> Column:
    """Decode every HTML entity. Only the entities travel to Python, whatever the texts' size."""
    marked = F.contains(c, F.lit("&"))
    found = F.when(marked, F.regexp_extract_all(c, F.lit(V.ENTITY), F.lit(0)))
    decoded = _unescape(F.coalesce(found, F.array().cast("array<string>")))
    between = F.split(c, V.ENTITY, -1)
    pieces = F.zip_with(between, F.concat(decoded, F.array(F.lit(""))), lambda text, entity: F.concat(text, entity))
    return F.when(marked, F.concat_ws("", pieces)).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, V.TAG, "")


def strip_html(c: Column) -> Column:
    """Decode entities, then drop tags, so encoded tags go as well."""
    return strip_tags(html_unescape(c))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, V.URL, "")


def remove_emails(c: Column) -> Column:
    """Drop whitespace-delimited tokens of the shape ``x@y.z``."""
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, V.EMAIL, "")).otherwise(c)


def remove_phone_numbers(c: Column) -> Column:
    """Drop phone numbers; any run of seven or more digits counts as one."""
    return F.when(c.rlike(V.PHONE_GATE), F.regexp_replace(c, V.PHONE, "")).otherwise(c)


def remove_emojis(c: Column) -> Column:
    """Drop every code point above U+FFFF."""
    return F.regexp_replace(c, V.EMOJI, "")


def remove_special_characters(c: Column, keep_basic: bool = True) -> Column:
    return F.regexp_replace(c, V.NOT_BASIC if keep_basic else V.NOT_ALNUM, "")


def normalize_case(c: Column, mode: str = "lowercase") -> Column:
    if mode == "lowercase":
        return F.lower(c)
    if mode == "uppercase":
        return F.upper(c)
    if mode == "title":
        # a capital starts every run of cased letters, also after ' - or a digit
        runs = F.regexp_extract_all(c, F.lit(V.CASED_RUN), F.lit(1))
        return F.array_join(F.transform(runs, F.initcap), "")
    raise ValueError(f"case mode must be one of {CASE_MODES}, not {mode!r}")


def remove_extra_spaces(c: Column, keep_paragraphs: bool = False) -> Column:
    """Collapse spaces, strip every line and the whole text.

    A line's whitespace includes its neighbouring blank lines, so ``a\\n\\nb``
    becomes ``ab``; ``keep_paragraphs`` strips within lines only.
    """
    ws = f"[{V.WS}&&[^\\n]]" if keep_paragraphs else f"[{V.WS}]"
    c = F.regexp_replace(c, "  +", " ")
    # (?d): only LF ends a line. A trailing run is tried from its first character only,
    # which keeps long runs linear.
    edge = rf"(?Umd)^{ws}+|(?<!{ws}){ws}+$"
    return strip(F.regexp_replace(c, edge, ""))


def remove_extra_linebreaks(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def replace_special_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, V.SPECIAL_SPACES, " ")


def replace_escape_characters(c: Column) -> Column:
    """CR LF, CR, form feed and vertical tab become LF; NUL is dropped."""
    return F.replace(F.regexp_replace(c, r"\r\n?|[\f\x0b]", "\n"), F.lit("\x00"), F.lit(""))


@F.pandas_udf(StringType())
def _decode_ignore(s: pd.Series) -> pd.Series:
    return s.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def decode_dropping_invalid(raw: Column) -> Column:
    """Bytes to text without the bytes that are not UTF-8.

    Valid rows are decoded by the engine; only the others travel to Python.
    """
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, raw.cast("string")).otherwise(_decode_ignore(F.when(~valid, raw)))


def char_count(c: Column) -> Column:
    return F.length(c).cast("long")


def word_count(c: Column) -> Column:
    """Runs of other than whitespace: each becomes one character, then they are counted."""
    ws = V.WS
    words = F.length(F.regexp_replace(c, rf"(?U)[{ws}]*+[^{ws}]++[{ws}]*+", "x"))
    return F.when(c.rlike(rf"(?U)[^{ws}]"), words).otherwise(F.lit(0)).cast("long")


def line_array(c: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: a final terminator adds no line."""
    body = F.regexp_replace(c, rf"(?:{V.LINE_END})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, V.LINE_END))


def line_count(c: Column) -> Column:
    """Line ends, plus one for text after the last of them."""
    ends = V.LINE_END_CHARS
    n = F.length(F.regexp_replace(c, rf"[^{ends}]++|\r(?=\n)", ""))
    return (n + F.right(c, F.lit(1)).rlike(rf"[^{ends}]").cast("int")).cast("long")


def sentence_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^.!?]++", "")).cast("long")


def text_stats(c: Column) -> Column:
    """Struct of the four counts; null counts as the empty text."""
    c = as_text(c)
    return F.struct(
        char_count(c).alias("chars"),
        word_count(c).alias("words"),
        line_count(c).alias("lines"),
        sentence_count(c).alias("sentences"),
    )


def preview(c: Column, n: int = V.PREVIEW_CHARS) -> Column:
    return F.substring(c, 1, n)
