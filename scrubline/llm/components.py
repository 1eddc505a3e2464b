"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import stored

SALTS = 8


def _with_least(arcs: DataFrame) -> DataFrame:
    """Arcs ``(u, v)`` with ``m``, the least of u and all its v. A node with very many
    arcs is split over ``SALTS`` tasks."""
    least = (
        arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        .withColumn("s", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    )
    return arcs.withColumn("s", F.expr(f"cast(pmod(xxhash64(v), {SALTS}) as int)")).join(least, ["u", "s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the least node reachable.

    Alternating large and small stars: every round hangs neighbours under the least node
    known, until each component is one star. A round is a few shuffles of the edges, its
    result is a written table, and no neighbour list is gathered. Self-loops and repeated
    edges are allowed; an edge with a null end is no edge. No edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v")
            ).distinct()
        before = state
        both = now.union(now.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.where("u <> v").distinct(), "edges")
