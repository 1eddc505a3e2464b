"""Exact, linearly interpolated quantiles that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.plans.materialize import materialize
from scrubline.plans.names import quoted as _q

SMALL_ROWS = 500_000
SAMPLE_ROWS = 1_000_000
ACCURACY = 10_000
SLACK = 0.005  # ten standard errors of a rank in a sample of a million


@dataclass
class _Bracket:
    """Wanted order statistics (0-based ranks) and the value range [lo, hi] they lie in."""

    column: str
    ranks: list[int]
    lo: float
    hi: float
    held: tuple[float, float]  # the tightest range known to hold the ranks
    slack: float = SLACK


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], small_rows: int = SMALL_ROWS
) -> dict[str, list[float | None]]:
    """``{column: [quantile for each prob]}`` of the non-null, non-NaN values.

    One pass counts. If no column has more than ``small_rows`` values, the built-in
    exact percentile runs. Otherwise a sketch of a bounded sample brackets every
    wanted rank, a pass over all rows counts the distinct values inside the brackets,
    and the ranks are read off the running count. The counts show whether a bracket
    holds its rank: one that does not is widened to the whole range, one with too many
    distinct values is narrowed first. So the sample never decides a result.
    """
    columns, probs = list(columns), list(probs)
    # numbered names: those of the table may hold any character
    names = [f"c{i}" for i in range(len(columns))]
    clean = df.select(*[F.nanvl(F.col(_q(c)).cast("double"), F.lit(None)).alias(n) for c, n in zip(columns, names)])
    labels, columns = columns, names
    row = clean.agg(
        *[f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in
          (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    counts = [row[f"n{i}"] for i in range(len(columns))]

    if max(counts) <= small_rows:
        at = F.array(*map(F.lit, probs))
        values = clean.agg(*[F.percentile(c, at).alias(f"p{i}") for i, c in enumerate(columns)]).first()
        return {c: list(values[f"p{i}"] or [None] * len(probs)) for i, c in enumerate(labels)}

    grid = [min(1.0, max(0.0, p + d)) for p in probs for d in (-SLACK, SLACK)]
    sketch = _sample(clean, max(counts)).agg(
        *[F.percentile_approx(c, grid, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    whole = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    wanted: list[_Bracket] = []
    for i, c in enumerate(columns):
        q = sketch[f"q{i}"] or [row[f"lo{i}"], row[f"hi{i}"]] * len(probs)
        for j, p in enumerate(probs):
            if counts[i]:
                lower = floor((counts[i] - 1) * p)
                ranks = sorted({lower, min(lower + 1, counts[i] - 1)})
                wanted.append(_Bracket(c, ranks, q[2 * j], q[2 * j + 1], whole[c]))
    found = _order_statistics(clean, wanted, small_rows)

    result = {}
    for i, (label, c) in enumerate(zip(labels, columns)):
        result[label] = []
        for p in probs:
            if not counts[i]:
                result[label].append(None)
                continue
            pos = (counts[i] - 1) * p
            lower = floor(pos)
            a, b = found[c, lower], found[c, min(lower + 1, counts[i] - 1)]
            # the order of operations of the built-in percentile, so both paths agree to the last bit
            result[label].append(a if a == b or pos == lower else (lower + 1 - pos) * a + (pos - lower) * b)
    return result


def _sample(df: DataFrame, n: int) -> DataFrame:
    return df if n <= SAMPLE_ROWS else df.sample(SAMPLE_ROWS / n, seed=17)


def _order_statistics(
    df: DataFrame, wanted: list[_Bracket], limit: int
) -> dict[tuple[str, int], float]:
    """``{(column, rank): value}`` for the wanted ranks."""
    found: dict[tuple[str, int], float] = {}
    while wanted:
        # one scan: per bracket, how many values lie below it and which lie in it
        cells = []
        for k, w in enumerate(wanted):
            v = F.col(w.column)
            inside = F.when(v >= F.lit(w.lo), v).alias("v")
            cells.append(F.when(v <= F.lit(w.hi), F.struct(F.lit(k).alias("k"), inside)))
        counted = materialize(
            df.select(F.explode(F.array(*cells)).alias("cell"))
            .where("cell is not null")
            .groupBy("cell.k", "cell.v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        sizes = {
            r["k"]: r
            for r in counted.groupBy("k")
            .agg(
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("below"),
                F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("inside"),
                F.count("v").alias("distinct"),
            )
            .collect()
        }
        ready, retry = {}, []
        for k, w in enumerate(wanted):
            s = sizes.get(k)
            held = s is not None and s["below"] <= w.ranks[0] and w.ranks[-1] < s["below"] + s["inside"]
            if not held:
                if (w.lo, w.hi) == w.held:
                    raise RuntimeError(f"ranks {w.ranks} lie outside column {w.column}")
                # the sample missed: back to the last range that held, with more slack
                w.lo, w.hi = w.held
                w.slack *= 4
                retry.append(w)
            elif s["distinct"] > limit and _narrow(df, w, s["below"], s["inside"]):
                retry.append(w)
            else:
                ready[k] = w
        if ready:
            # at most ``limit`` distinct values per bracket reach a task
            run = F.sum("n").over(Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first()))
            ranks = F.create_map(
                *[F.lit(x) for k, w in ready.items() for x in (k, f"{w.ranks[0]},{w.ranks[-1]}")]
            )
            rank = F.explode(F.array_distinct(F.split(ranks[F.col("k")], ",").cast("array<bigint>")))
            rows = (
                counted.where(F.col("k").isin(*ready))
                .select("k", "v", run.alias("run"))
                .select("k", "v", "run", rank.alias("rank"))
                .where(F.col("v").isNotNull() & (F.col("run") > F.col("rank")))
                .groupBy("k", "rank")
                .agg(F.min("v").alias("v"))
                .collect()
            )
            for r in rows:
                found[ready[r["k"]].column, r["rank"]] = r["v"]
        wanted = retry
    return found


def _narrow(df: DataFrame, w: _Bracket, below: int, inside: int) -> bool:
    """Tighten a bracket that holds its ranks; false when it cannot be split further.
    Every miss widens the slack, so this ends."""
    w.held = (w.lo, w.hi)
    if w.slack >= 0.5:
        return False
    first, last = ((r - below) / max(inside - 1, 1) for r in (w.ranks[0], w.ranks[-1]))
    slack = max(w.slack, 2 / inside)
    v = F.col(w.column)
    q = (
        _sample(df.where(v.between(F.lit(w.lo), F.lit(w.hi))), inside)
        .agg(F.percentile_approx(v, [max(0.0, first - slack), min(1.0, last + slack)], ACCURACY).alias("q"))
        .first()["q"]
    )
    if q is None or (q[0], q[1]) == w.held:
        return False
    w.lo, w.hi = q
    return True
