"""Streaming extensions: ingest without duplicates, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash


def read_documents(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def without_duplicates(documents: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Documents whose content hash has not come within the watermark; its state is bounded by it."""
    return documents.withColumn("content_sha256", content_hash(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_sha256"])


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """begin, event_type, n, total and about how many users, by tumbling window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("window.start").alias("begin"), "event_type", "n", "total", "users")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
