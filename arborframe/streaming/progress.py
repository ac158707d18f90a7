"""Progress events as a stream: the same fold as in batch, kept up by late events within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event files as they arrive; the schema is that of the files there are."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def fold(events: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of each kind of event per window."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def merge_documents(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """A micro-batch of documents upserted by key: for foreachBatch sinks."""
    return existing.join(batch.select("key"), "key", "left_anti").unionByName(batch)
