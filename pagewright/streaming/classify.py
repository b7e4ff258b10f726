"""Streaming: glyphs are classified as they arrive, and windows count classes with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn


def classify_stream(glyphs: DataFrame, train: DataFrame, path: str, checkpoint: str, k: int = 1) -> StreamingQuery:
    """Appends (batch, q, class, n, total) of each micro-batch as Parquet; a batch that is retried replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        found = knn.classify(batch.select("id", "features"), train, k)
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return glyphs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, key, n): counts of a stream (or table) by time windows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
