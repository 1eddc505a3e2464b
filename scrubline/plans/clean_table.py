"""The table cleaning plan: headers, cells, dates, case, duplicates, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions.fixed_values import TABLE_STEP_LABELS as LABELS
from scrubline.operators import dates, outliers, table
from scrubline.operators.table import string_columns
from scrubline.options import TableOptions
from scrubline.plans.materialize import stored


def clean_table(
    df: DataFrame,
    options: TableOptions = TableOptions(),
    row_key: str | None = None,
    with_counts: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and its report ``(step_no, step, rows_affected)``.

    ``row_key`` stands for file order (the first value of a column decides its date
    layout). It belongs to no step: it is not compared for duplicates and not tested
    for outliers. Without one, the scan position is used for the date vote only.
    ``with_counts=False`` leaves the row counts out and saves their jobs.
    """
    spark = df.sparkSession
    log: list[tuple[str, int | None]] = []
    data = [c for c in df.columns if c != row_key]

    if options.strip_headers:
        before = df.columns
        df = table.strip_headers(df)
        row_key = row_key.strip() if row_key else None
        data = [c for c in df.columns if c != row_key]
        if df.columns != before:
            log.append((LABELS["headers"], None))
    texts = [c for c in string_columns(df) if c != row_key]
    if options.strip_strings:
        df = table.strip_strings(df)
        if texts:
            log.append((LABELS["cells"].format(n=len(texts)), None))
    if options.convert_dates and texts:
        key, source = row_key, df
        if key is None:
            key, source = "_position", with_position(df)
        found = dates.detect_dates(source, key, texts, options.date_order)
        if found:
            df = table._replace_columns(df, {c: dates.parse_date(F.col(table._q(c)), f) for c, f in found.items()})
            first = options.date_order == "global"
            log.append((LABELS["dates"].format(n=len(found), columns=", ".join(found), day_first=first), None))
        texts = [c for c in texts if c not in found]
    if options.lowercase_text:
        df = table.lowercase_text(df)
        if texts:
            log.append((LABELS["lowercase"].format(n=len(texts)), None))

    rows = df.count() if with_counts and (options.remove_duplicates or options.remove_outliers) else None
    if options.remove_duplicates:
        df = table.drop_duplicates(df, row_key)
        if options.remove_outliers or with_counts:
            df = stored(df, "table")  # shuffled once; every later statistic reads its own columns
        if with_counts:
            left = df.count()
            text = LABELS["duplicates"].format(n=rows - left) if rows > left else LABELS["no_duplicates"]
            log.append((text, rows - left))
            rows = left
        else:
            log.append((LABELS["duplicates_uncounted"], None))
    if options.remove_outliers:
        numbers = [c for c in table.numeric_columns(df) if c in data]
        method = options.outlier_method
        if method == "z_score":
            df = outliers.remove_outliers_zscore(df, numbers, options.outlier_threshold)
        else:
            df = outliers.remove_outliers_iqr(df, numbers)
        if with_counts:
            gone = rows - df.count()
            name = method.upper()
            log.append((LABELS["outliers" if gone else "no_outliers"].format(n=gone, method=name), gone))
        else:
            log.append((LABELS["outliers_uncounted"].format(method=method.upper()), None))

    report = spark.createDataFrame(
        [(i + 1, s, n) for i, (s, n) in enumerate(log)], "step_no int, step string, rows_affected long"
    )
    return df, report


def with_position(df: DataFrame, name: str = "_position") -> DataFrame:
    """Scan position as a key: file order within one file, no promise across files."""
    return df.withColumn(name, F.monotonically_increasing_id())
