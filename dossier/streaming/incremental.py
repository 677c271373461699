"""Restartable processing: what a run has finished is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Applies step to the JSON files that arrived since the last run and appends what it gives; the checkpoint remembers the files."""
    rows = spark.readStream.schema(schema).json(source)
    return step(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_key(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The stream without repeats of a key within the lateness that the watermark allows."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(rows: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))
