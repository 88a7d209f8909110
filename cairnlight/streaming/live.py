"""Live view of a call log: incremental reading, repeated records, sliding summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sliding_summary(events: DataFrame, length: str = "60 seconds", step: str = "2 seconds", ts: str = "ts") -> DataFrame:
    """Counts, errors, sum and median of the events in each sliding window; for batches and streams."""
    return events.groupBy(F.window(ts, length, step)).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"), F.median("value").alias("middle")
    )


def tail(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Stream of the JSON log files that appear under ``path``; its place is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_records(stream: DataFrame, keys: list[str], ts: str, lateness: str = "10 minutes") -> DataFrame:
    """Each record once, as long as repeats come within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def live_summary(stream: DataFrame, length: str = "60 seconds", step: str = "2 seconds", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Streaming form of ``sliding_summary`` without the exact median, which needs all values of a window."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, length, step))
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"), F.percentile_approx("value", 0.5).alias("middle"))
    )
