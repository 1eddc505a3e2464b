"""Names of output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.plans import ordered as O
from scrubline.plans.materialize import materialize


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def extension(name: Column) -> Column:
    """The last suffix with its dot; a leading dot starts no suffix."""
    return F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1)


def sequential_names(
    df: DataFrame, order_by: str, prefix: str, ext: str, name: str = "filename",
    rows_per_bucket: int = O.ROWS_PER_BUCKET,
) -> DataFrame:
    """``prefix_001.ext`` by position in the input; failed rows count too, so number
    before splitting them off."""
    numbered = O.with_row_number(df, order_by, "_no", rows_per_bucket=rows_per_bucket)
    text = F.format_string(f"{prefix.replace('%', '%%')}_%03d.{ext.lower().replace('%', '%%')}", F.col("_no"))
    return numbered.withColumn(name, text).drop("_no")


def processed_name(name: Column, ext: Column | str) -> Column:
    """``base_processed.ext``; ``ext`` carries its dot."""
    return F.concat(stem(name), F.lit("_processed"), F.lit(ext) if isinstance(ext, str) else ext)


def unique_names(
    df: DataFrame, name: str, order_by: str, output: str = "unique_name",
    rows_per_bucket: int = O.ROWS_PER_BUCKET,
) -> DataFrame:
    """Give later copies of a name a counter: ``a.png``, ``a_1.png``, ``a_2.png``.

    A counter whose name is itself in the input is passed over, so the result has
    no clash and every first copy keeps its name. The j-th copy takes the j-th
    counter that is not taken: taken counter number i with value k pushes on every
    copy with ``j > k - i``, which is a running count over copies and taken counters
    together. No group is gathered in one task.
    """
    ranked = materialize(
        O.with_row_number(df, order_by, "_copy", [name], rows_per_bucket).withColumn("_copy", F.col("_copy") - 1)
    )
    pattern = r"^(.+)_([1-9][0-9]{0,17})$"
    s = stem(F.col(name))
    taken = (
        ranked.where((F.col("_copy") == 0) & s.rlike(pattern))
        .select(
            F.concat(F.regexp_extract(s, pattern, 1), extension(F.col(name))).alias("_base"),
            F.regexp_extract(s, pattern, 2).cast("long").alias("_k"),
        )
    )
    # a base without copies passes through too: no join on a base that may hold most names
    taken = O.with_row_number(materialize(taken), "_k", "_i", ["_base"], rows_per_bucket)
    marks = taken.select("_base", (2 * (F.col("_k") - F.col("_i")) + 1).alias("_at"), F.lit(1).alias("_push"))
    copies = ranked.where("_copy > 0").select(
        *df.columns, "_copy", F.col(name).alias("_base"), (2 * F.col("_copy")).alias("_at"), F.lit(0).alias("_push")
    )
    pushed = O.running_total(
        copies.unionByName(marks, allowMissingColumns=True), F.col("_push"), "_at", "_pushed", ["_base"], rows_per_bucket
    ).where("_copy is not null")
    counter = (F.col("_copy") + F.col("_pushed")).cast("string")
    renamed = F.concat(stem(F.col(name)), F.lit("_"), counter, extension(F.col(name)))
    return (
        ranked.where("_copy = 0").select(*df.columns, F.col(name).alias(output))
        .unionByName(pushed.select(*df.columns, renamed.alias(output)))
    )
