"""Structured Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.sources.tables import shared_folder


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per tumbling window and type, on a stream or a table; state older than ``late`` is dropped on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = timed.withWatermark("ts", late) if events.isStreaming else timed
    table = held.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return table.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def replay(spark: SparkSession, folder: str, size: str = "1 hour") -> DataFrame:
    """Streams the events table once to its end and returns the written result; state and output live in the shared folder."""
    out = shared_folder(spark, "event-windows")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(folder)
    query = (windowed(stream, size).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
             .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/rows")).start())
    query.awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n bigint, total double").parquet(f"{out}/rows")
