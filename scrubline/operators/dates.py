"""Finding and reading date columns.

A text's signature is the text with every digit as 9 and words cut to three letters. Whether a layout can read a text depends on its signature alone, so
signatures are counted once and layouts resolved for each of them, not for each row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.operators.table import _q, _replace_columns, string_columns

_TIMES = ("", " H:m", " H:m:s", " H:m:s.SSSSSSSSS")
_ISO_TIMES = tuple(t.replace(" ", "'T'") for t in _TIMES[1:])
_SEPARATORS = ("-", "/", ".")
_ZONE = "XXX"


def _numeric(*orders: str) -> list[str]:
    """Orders of numbers with every separator and time; a year first may have a T."""
    return [
        o.replace("?", s) + t for o in orders for s in _SEPARATORS for t in _TIMES + (_ISO_TIMES if o.startswith("yyyy") else ())
    ]


def _with(bases: Sequence[str], tails: Sequence[str]) -> list[str]:
    return [b + t for b in bases for t in tails]


@cache
def strict_layouts(date_order: str) -> tuple[str, ...]:
    """Layouts a first value can set for its whole column, in the order they are tried."""
    year, month_first, day_first = _numeric("yyyy?M?d"), _numeric("M?d?yyyy"), _numeric("d?M?yyyy")
    first, second = year + month_first, _numeric("yyyy?d?M") + day_first
    if date_order == "global":
        first, second = second, first
    clocks = lambda made: _with([x for x in made if "H" not in x], V.CLOCK_TIMES)
    zoned = lambda made: [x + _ZONE for x in made if x.startswith("yyyy") and "H" in x]
    named = _with(V.MONTH_NAME_LAYOUTS, _TIMES) + _with(V.MONTH_NAME_LAYOUTS, V.CLOCK_TIMES) + list(V.WEEKDAY_LAYOUTS)
    return tuple(dict.fromkeys([
        *V.PLAIN_LAYOUTS, *first, *clocks(first), *zoned(first), *named, *second, *clocks(second), *zoned(second)]))


@cache
def loose_layouts(date_order: str) -> tuple[str, ...]:
    """Layouts for values read one by one: those of ``strict_layouts`` without zones, and
    those no column is guessed by. A year first is followed by its month."""
    short = [x for o in ("M?d?yy", "d?M?yy") for x in _numeric(o)]
    if date_order == "global":
        short = [x for o in ("d?M?yy", "M?d?yy") for x in _numeric(o)]
    short += _numeric("yy?d?M", "yy?M?d") if date_order == "global" else _numeric("yy?M?d")
    short += _with([x.replace("yyyy", "yy") for x in V.MONTH_NAME_LAYOUTS], _TIMES)
    seconds = [x + t for x in strict_layouts(date_order) if "H" not in x and "h" not in x and "d" in x for t in V.CLOCK_SECONDS]
    plain = [x for x in strict_layouts(date_order) if _ZONE not in x]
    return tuple(dict.fromkeys([*V.PLAIN_LAYOUTS, *_numeric("yyyy?M?d"), *plain, *seconds, *short, *V.MONTH_YEAR_LAYOUTS]))


_SHAPES = (  # longest letter run first
    ("SSSSSSSSS", r"\d{1,9}"), ("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("MMMM", "(?:%s)" % "|".join(V.MONTHS)),
    ("MMM", "(?:%s)" % "|".join(m[:3] for m in V.MONTHS)), ("EEEE", "(?:%s)" % "|".join(V.WEEKDAYS)),
    ("EEE", "(?:%s)" % "|".join(d[:3] for d in V.WEEKDAYS)), ("XXX", r" ?(?:Z|UTC|[+-]\d{2}:?\d{2})"), ("MM", r"\d{2}"), ("dd", r"\d{2}"),
    ("HH", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"), ("a", "[AP]M"), ("'T'", "T"), ("'GMT'", "GMT"), (".", r"\."),
    *[(c, r"\d{1,2}") for c in "MdHhms"],
)


_RANGES = {"M": "(?:1[0-2]|0?[1-9])", "d": r"(?:[12]\d|3[01]|0?[1-9])", "MM": r"(?:0[1-9]|1[0-2])", "dd": r"(?:0[1-9]|[12]\d|3[01])"}


@cache
def _shape(layout: str, exact: bool = False) -> str:
    """A pattern, whatever the case, for the texts a layout can read; the ``exact`` one
    leaves out impossible months and days."""
    out = ""
    while layout:
        token, pattern = next(((t, p) for t, p in _SHAPES if layout.startswith(t)), (layout[0], layout[0]))
        out, layout = out + (_RANGES.get(token, pattern) if exact else pattern), layout[len(token) :]
    return rf"\s*{out}\s*"


def _fits(layout: str, text: str) -> bool:
    return re.fullmatch(_shape(layout), text, re.IGNORECASE) is not None


def _read(c: Column, layout: str) -> Column:
    """A text of the layout's shape as a timestamp; without a zone unless the layout has one."""
    c = F.trim(c)
    if layout.startswith("EEE"):
        c = F.regexp_replace(c, r"^[A-Za-z]+,? ", "")
        layout = re.sub("^E+,? ", "", layout)
    if layout.endswith(_ZONE):
        c = F.regexp_replace(F.regexp_replace(c, "(?i) ?(?:Z|UTC)$", "Z"), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
        return F.try_to_timestamp(c, F.lit(layout))
    found = F.try_to_timestamp(c, F.lit(layout)).cast("timestamp_ntz")
    if re.search("(?<!y)yy(?!y)", layout):
        # Years of two digits lie within fifty years of the present one.
        late = F.year(found) >= date.today().year + 50
        found = F.when(late, found - F.expr("interval 100 years")).otherwise(found)
    return found


def _parse(c: Column, layout: str) -> Column:
    # text of another shape is not handed to the parser, whose failures are slow
    return F.when(c.rlike(f"(?i)^{_shape(layout, exact=True)}$"), _read(c, layout))


def signature(c: Column) -> Column:
    """Equal for texts that the same layouts can read: digits are 9, of a word its first
    three letters stay. Null for a text with other words than names of dates."""
    s = F.translate(F.lower(F.trim(c)), "0123456789", "9" * 10)
    words = F.regexp_replace(s, "([a-z]{3})[a-z]+", "$1~")
    names = "|".join([m[:3] for m in V.MONTHS] + [d[:3] for d in V.WEEKDAYS] + ["utc", "gmt", "[ap]m"])
    dated = words.rlike(rf"^(?:[9:./,+\- ]++|(?:{names})(?![a-z])~?|[tz](?![a-z]))++$")
    return F.when(c.rlike(_PLAUSIBLE), F.when(~s.rlike("[a-z]"), s).when(dated, words))


def _example(sign: str) -> str:
    """A text with a signature: its long words as full names."""
    full = {x[:3] + "~": x for x in (*V.MONTHS, *V.WEEKDAYS)}
    return re.sub("[a-z]{3}~", lambda m: full.get(m[0], m[0]), sign)


#: What any layout can read looks like this.
_PLAUSIBLE = r"^\s*[^\d]{0,20}\d[\w\s:./,+\-]{2,40}$"


class Signatures(NamedTuple):
    """How the values of a column without one layout are read: layouts for each signature."""

    layouts: tuple[tuple[str, tuple[str, ...]], ...]


def parse_date(c: Column, how: Sequence[str] | Signatures) -> Column:
    """Timestamp by the one layout of a column, or by the first that reads a value; null
    where none does."""
    if not isinstance(how, Signatures):
        return F.coalesce(*[_parse(c, x) for x in how])
    sign, by = signature(c), {}
    for text, layouts in how.layouts:
        by.setdefault(layouts, []).append(text)
    out = None
    for layouts, texts in by.items():
        value = _read(c, layouts[0]) if len(layouts) == 1 else F.coalesce(*[_parse(c, x) for x in layouts])
        out = F.when(sign.isin(texts), value) if out is None else out.when(sign.isin(texts), value)
    return F.lit(None).cast("timestamp_ntz") if out is None else out


def detect_dates(
    df: DataFrame, row_key: str, columns: Sequence[str] | None = None, date_order: str = "auto"
) -> dict[str, Sequence[str] | Signatures]:
    """How to read each string column that holds dates.

    The layout is the first candidate that reads the first non-null value by ``row_key``;
    when none does, every value is read by its signature. A column is a date column if more
    than half of ALL rows parse. One aggregate over all columns, one more over those that
    look like dates at all, and one for those without a layout.
    """
    columns = list(columns) if columns is not None else string_columns(df)
    if not columns:
        return {}
    looks = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.when(F.col(_q(c)).isNotNull(), F.struct(F.col(_q(row_key)), F.col(_q(c)).alias("v")))).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.col(_q(c)).rlike(_PLAUSIBLE)).alias(f"p{i}") for i, c in enumerate(columns)],
    ).first()
    likely = [(i, c) for i, c in enumerate(columns) if looks["n"] and looks[f"p{i}"] / looks["n"] > V.DATE_SHARE]
    if not likely:
        return {}
    how: dict[str, Sequence[str] | Signatures] = _by_first_value(df, {c: looks[f"f{i}"]["v"] for i, c in likely}, date_order)
    open_ = [c for _, c in likely if c not in how]
    if open_:
        how |= _by_signature(df, open_, date_order)
    votes = df.agg(*[F.count(parse_date(F.col(_q(c)), h)).alias(f"v{i}") for i, (c, h) in enumerate(how.items())]).first() if how else ()
    return {c: h for (c, h), v in zip(how.items(), votes) if v / looks["n"] > V.DATE_SHARE}


def _by_first_value(df: DataFrame, firsts: dict[str, str], date_order: str) -> dict[str, Sequence[str]]:
    tried = {c: [x for x in strict_layouts(date_order) if _fits(x, v)] for c, v in firsts.items()}
    tests = [(c, x) for c, layouts in tried.items() for x in layouts]
    if not tests:
        return {}
    row = df.sparkSession.range(1).select(
        *[_parse(F.lit(firsts[c]), x).isNotNull().alias(f"t{i}") for i, (c, x) in enumerate(tests)]).first()
    found: dict[str, Sequence[str]] = {}
    for (c, x), ok in zip(tests, row):
        if ok:
            found.setdefault(c, (x,))
    return found


def _by_signature(df: DataFrame, columns: list[str], date_order: str) -> dict[str, Signatures]:
    """Signatures hold no words but those of dates, so there are few of them."""
    signs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), signature(F.col(_q(c))).alias("s")) for i, c in enumerate(columns)]))
    rows = df.select(signs.alias("x")).select("x.*").where("s is not null").groupBy("i", "s").count().collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["s"])):
        layouts = tuple(x for x in loose_layouts(date_order) if _fits(x, _example(r["s"])))
        if layouts:
            out.setdefault(columns[r["i"]], []).append((r["s"], layouts))
    return {c: Signatures(tuple(x)) for c, x in out.items()}


def convert_dates(
    df: DataFrame, row_key: str, columns: Sequence[str] | None = None, date_order: str = "auto"
) -> tuple[DataFrame, list[str]]:
    """The frame with its date columns typed, and their names."""
    found = detect_dates(df, row_key, columns, date_order)
    new = {c: parse_date(F.col(_q(c)), layouts) for c, layouts in found.items()}
    return _replace_columns(df, new), list(found)
