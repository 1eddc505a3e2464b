"""Task count ahead of heavy row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out by ``keys`` when the scan gives fewer tasks than there are
    cores (one big row group, say). A scan with enough splits is left as it is, so
    large tables are not shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
