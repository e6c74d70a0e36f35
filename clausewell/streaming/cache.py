"""The keys used last, kept over a stream of uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.operators.logs import recently_used
from clausewell.sources.tables import shared_folder


def replay_recent(spark: SparkSession, folder: str, most: int = 32) -> DataFrame:
    """Streams the events to their end; the state is one row per user, their last use, and each batch writes the ``most`` users
    that a cache would hold after it. State and result live in the shared folder."""
    out = shared_folder(spark, "recent-users")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(folder)
    last = stream.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    query = (last.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
             .foreachBatch(lambda rows, _: recently_used(rows, "user_id", "ts", most).write.mode("overwrite").parquet(f"{out}/rows")).start())
    query.awaitTermination()
    return spark.read.schema("user_id bigint, last_used timestamp").parquet(f"{out}/rows")
