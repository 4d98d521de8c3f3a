"""Mergeable summaries of event-time windows, the same on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_sketches(events: DataFrame, time: str = "ts", value: str = "value", width: str = "1 hour", late: str = "2 hours", k: int = 256) -> DataFrame:
    """(start, n, least, greatest, sketch) of each window; late rows are dropped on streams after ``late``."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width)).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    ).select(F.col("window.start").alias("start"), "n", "least", "greatest", "sketch")


def read_stream(spark, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
