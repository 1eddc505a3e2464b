"""Overlapping tiles: neighbourhood operators with bounded groups and one shuffle.

A row is copied to every tile whose core needs it. Windows then run inside a
tile, so an image or a series of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tile_range(pos: Column, size: int, before: int, after: int) -> Column:
    first = F.greatest(F.floor((pos - after) / size), F.lit(0))
    last = F.floor((pos + before) / size)
    return F.sequence(first, F.greatest(first, last))


def add_tiles(
    df: DataFrame, pos: str, size: int, before: int, after: int, name: str = "_tile"
) -> DataFrame:
    """Copy each row to the tiles along ``pos`` (0, 1, 2, ...) that need it.

    A core row at position p may look at rows ``p - before .. p + after``.
    """
    return df.withColumn(name, F.explode(_tile_range(F.col(pos), size, before, after)))


def in_core(pos: str, size: int, name: str = "_tile") -> Column:
    return F.floor(F.col(pos) / size) == F.col(name)
