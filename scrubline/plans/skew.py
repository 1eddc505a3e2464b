"""Joining per-key results back to the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.plans.materialize import materialize
from scrubline.plans.names import quoted as _q

BROADCAST_ROWS = 200_000
HOT_SHARE = 1 / 256
SPLITS = 64


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    n_rows: str,
    spread: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    hot_share: float = HOT_SHARE,
    splits: int = SPLITS,
) -> DataFrame:
    """Inner join of ``rows`` with one row per key, safe against hot keys. Null keys match
    null keys.

    ``per_key`` is computed once and counted. Up to ``broadcast_rows`` keys it is
    broadcast and ``rows`` is not shuffled. Beyond that, keys holding more than
    ``hot_share`` of all rows (never more than ``1 / hot_share`` keys, so that list
    may be broadcast) are split over ``splits`` tasks by a hash of ``spread``, and
    everything is joined by shuffle. ``n_rows`` names the row count per key; it is
    dropped from the result.
    """
    keys = list(keys)
    per_key = materialize(per_key)
    size = per_key.agg(F.count(F.lit(1)).alias("n"), F.sum(n_rows).alias("total")).first()
    payload = per_key.drop(n_rows)
    if size["n"] <= broadcast_rows:
        return _matched(rows, F.broadcast(payload), keys)

    hot = per_key.where(F.col(n_rows) > F.lit(size["total"] * hot_share)).select(
        *map(_q, keys), F.lit(True).alias("_hot")
    )
    salt = F.when(
        F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(splits)).cast("int")
    ).otherwise(F.lit(0))
    salted_rows = (
        _matched(rows, F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_keys = (
        _matched(payload, F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot")
    )
    return _matched(salted_rows, salted_keys, [*keys, "_salt"]).drop("_salt")


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included, with each key once and first."""
    other = {k: f"_right{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(other)
    on = reduce(Column.__and__, [F.col(_q(k)).eqNullSafe(F.col(o)) for k, o in other.items()])
    rest = [F.col(_q(c)) for c in left.columns if c not in other]
    added = [F.col(_q(c)) for c in right.columns if c not in other]
    return left.join(renamed, on, how).select(*[F.col(_q(k)) for k in keys], *rest, *added)
