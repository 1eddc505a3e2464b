"""Session defaults for tests, benches and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "scrubline", cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session. A cluster job brings its own, with ``spark.checkpoint.dir`` set."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
