"""CSV scan and sink."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions import fixed_values as V
from scrubline.operators.table import _q
from scrubline.sources.csv_splits import parse_header, read_records

ROW_ID, CORRUPT = "_row_id", "_corrupt"
_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_FIELD = r'(?:^|,)(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'


def scan_files(spark: SparkSession, path) -> DataFrame:
    """``(file, utf8, open_quotes, header)`` per file.

    Lines are read raw, so files of any size are split over tasks. ``open_quotes``
    tells whether some line holds an odd number of quotes; without one no cell can
    span lines. ``header`` is equal for files with equal first lines: a line's place
    and hash are one number, so the first line is a plain minimum.
    """
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id() % (1 << 33))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    is_head = (F.col("_metadata.file_block_start") == 0) & (F.trim(_unmarked("value")) != "")
    size = F.lit(1 << 62).cast("decimal(20,0)") * 4
    hashed = F.pmod(F.xxhash64(_unmarked("value")).cast("decimal(20,0)"), size)
    first = F.min(F.when(is_head, (F.col("row").cast("decimal(12,0)") * size + hashed).cast("decimal(38,0)")))
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(quotes % 2 == 1).alias("open_quotes"),
        F.pmod(first, size).alias("header"),
    )


def _unmarked(column: str) -> Column:
    return F.regexp_replace(column, "^\ufeff", "")


def _read(spark: SparkSession, path, charset: str, names: list[str], prune: bool) -> DataFrame:
    # a scan that parses only the columns asked for does not see extra fields
    options = dict(
        columnPruning=prune,
        header=True, encoding=charset, quote='"', escape='"', inferSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1,
    )
    fields = [T.StructField(c, T.StringType()) for c in names]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path, schema=schema)


class Layout(NamedTuple):
    """How to read a set of files: by the engine's own scan, with the paths of each charset
    and the column names, or (no names) by split records."""

    path: object
    groups: list[tuple[object, str]]
    names: list[str] | None


def _layout(spark: SparkSession, path, multi_line: bool | None) -> Layout:
    files = scan_files(spark, path)
    seen = files.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("utf8")).alias("latin"), F.max("open_quotes").alias("quotes"),
        F.count_distinct("header").alias("headers"),
    ).first()
    if not seen["n"]:
        raise ValueError(f"no rows in {path}")
    if multi_line or seen["headers"] != 1 or (multi_line is None and seen["quotes"]):
        return Layout(path, [], None)
    # equal first lines everywhere: any of them names the columns
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(_unmarked("value").alias("value"), F.is_valid_utf8("value").alias("utf8"))
    head = lines.where(F.trim("value") != "").select(F.col("value").cast("binary").alias("raw"), "utf8").first()
    names = parse_header(bytes(head["raw"]), head["utf8"])
    if not seen["latin"] or seen["latin"] == seen["n"]:
        return Layout(path, [(path, "ISO-8859-1" if seen["latin"] else "UTF-8")], names)
    # file names only, which the driver lists for any scan
    by_file = files.select("file", "utf8").collect()
    return Layout(path, [
        ([r["file"] for r in by_file if r["utf8"]], "UTF-8"),
        ([r["file"] for r in by_file if not r["utf8"]], "ISO-8859-1"),
    ], names)


def _raw(spark: SparkSession, layout: Layout, prune: bool) -> DataFrame:
    if layout.names is None:
        rows, names = read_records(spark, layout.path)
        cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)]
        return rows.select(*cells, F.col("extra").alias(CORRUPT), F.col("id").alias(ROW_ID))
    parts = [_read(spark, paths, charset, layout.names, prune) for paths, charset in layout.groups]
    df = reduce(DataFrame.union, parts).withColumn(ROW_ID, F.monotonically_increasing_id())
    return df if prune else df.withColumn(CORRUPT, F.when(_too_many_fields(len(layout.names)), F.col(CORRUPT)))


def read_csv_raw(spark: SparkSession, path, multi_line: bool | None = None) -> DataFrame:
    """All cells as strings, plus ``_row_id`` (file order within one file) and
    ``_corrupt`` (the record, where it has too many fields).

    Files that are not valid UTF-8 are read as Latin-1, the others as UTF-8. Columns are
    matched by name where headers differ; a name that repeats gets ``.1``, ``.2`` and so on.
    Files are split over tasks in every case. ``multi_line=None`` looks for cells that span
    lines only if a line has an odd number of quotes.
    """
    return _raw(spark, _layout(spark, path, multi_line), prune=False)


def _too_many_fields(n_columns: int) -> Column:
    """Rows with more fields than the header; missing trailing fields are only nulls."""
    fields = F.size(F.regexp_extract_all(F.col(CORRUPT), F.lit(_FIELD), F.lit(0)))
    return F.col(CORRUPT).isNotNull() & (fields > n_columns)


def null_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(_q(c)).isin(*V.NA_TOKENS), F.col(_q(c))) for c in columns})


def infer_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Narrowest of bigint, double, boolean, string that holds every non-null cell."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(_q(c))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(_INT), v.try_cast("bigint"))).alias(f"i{i}"),
            F.count(F.when(v.rlike(_FLOAT), v.try_cast("double"))).alias(f"d{i}"),
            F.count_if(v.isin(*V.BOOL_TOKENS)).alias(f"b{i}"),
        ]
    r = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        if n and r[f"i{i}"] == n:
            kinds[c] = "bigint"
        elif r[f"d{i}"] == n:
            kinds[c] = "double"  # also a column without any value
        elif r[f"b{i}"] == n:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def read_csv(
    spark: SparkSession, path, infer: bool = True, multi_line: bool | None = None, keep_row_id: bool = False,
    on_bad_rows: str = "raise",
) -> DataFrame:
    """Typed table. Empty input and (``on_bad_rows='raise'``) rows with too many
    fields raise; ``on_bad_rows='drop'`` leaves them to ``read_bad_rows``."""
    if on_bad_rows not in ("raise", "drop"):
        raise ValueError("on_bad_rows must be 'raise' or 'drop'")
    layout = _layout(spark, path, multi_line)
    raw = _raw(spark, layout, prune=False)
    columns = [c for c in raw.columns if c not in (ROW_ID, CORRUPT)]
    bad = F.col(CORRUPT).isNotNull()
    # the scan may not be asked for the corrupt column alone, hence the count of a cell
    seen = raw.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count(F.col(_q(columns[0]))).alias("cells")
    ).first()
    if not seen["n"]:
        raise ValueError(f"no rows in {path}")
    if seen["bad"] and on_bad_rows == "raise":
        raise ValueError(f"{path} has {seen['bad']} rows with too many fields")
    # without bad rows the scan may parse only the columns a query uses
    raw = raw.where(~bad) if seen["bad"] or layout.names is None else _raw(spark, layout, prune=True)
    df = null_tokens(raw.drop(CORRUPT), columns)
    kinds = infer_types(df, columns) if infer else {}
    typed = [F.col(_q(c)).try_cast(kinds.get(c, "string")).alias(c) for c in columns]
    return df.select(*typed, *([ROW_ID] if keep_row_id else []))


def read_bad_rows(spark: SparkSession, path) -> DataFrame:
    """``(_row_id, _corrupt, first_cell)`` of the rows with too many fields, or with a quote
    that is never closed."""
    rows, _ = read_records(spark, path)
    return rows.where("extra is not null").select(
        F.col("id").alias(ROW_ID), F.col("extra").alias(CORRUPT), F.get("cells", F.lit(0)).alias("first_cell"))


def csv_name(name: str) -> str:
    return name if name.lower().endswith(".csv") else f"{name}.csv"


def write_csv(df: DataFrame, path: str) -> str:
    """Header, no index, ``.csv`` added to the folder name if missing."""
    path = csv_name(path)
    df.write.options(
        header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path
