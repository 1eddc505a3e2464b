"""The row-wise cleaning steps on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scrubline.options import TextOptions
from scrubline.plans.clean_text import clean_text


def text_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Parquet files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).parquet(folder)


def clean_text_stream(
    docs: DataFrame, target: str, checkpoint: str, options: TextOptions = TextOptions()
) -> StreamingQuery:
    """Clean what has arrived since the last run and stop. The steps keep no state, so
    a restart needs the file offsets in ``checkpoint`` only."""
    return (
        clean_text(docs, options=options)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
