"""Sessions over late data: gaps close them, a watermark ends them, and rows that come too late are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.streaming.arrivals import drained, stream


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """key, session_start, session_end, n and total of an event stream; a session is emitted once, when the watermark has passed its end."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    found = held.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def run(spark: SparkSession, schema, folder: str, out: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """Drains the events that arrived in ``folder``: the sessions that ended, and the rows that came too late for any.

    A row is late when its own session would have ended by the watermark with which the batch before it emitted sessions:
    the greatest time of the batches before that one, less ``late``. That is what the aggregation drops. Both outputs are written by batch, so a batch that runs again
    replaces what it wrote. Sessions that the watermark has not passed stay in the state.
    """
    events = stream(spark, schema, folder)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/sessions/batch={batch}")

    def split(rows: DataFrame, batch: int) -> None:
        clock = spark.read.schema("batch int, seen timestamp").parquet(f"{out}/clock") if batch else None
        before = clock.filter(F.col("batch") < batch - 1).agg(F.max("seen")).first()[0] if clock else None
        rows.agg(F.max("ts").alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{out}/clock/batch={batch}")
        dropped = rows.filter(F.lit(before is not None) & (F.expr(f"ts + interval '{gap}'") <= F.expr(f"timestamp '{before or '1970-01-01'}' - interval '{late}'")))
        dropped.write.mode("overwrite").parquet(f"{out}/late/batch={batch}")

    for name, rows, sink in (("sessions", sessions(events, key, gap, late), write), ("late", events, split)):
        drained(rows.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state/{name}").foreachBatch(sink).start())
    found = spark.read.schema(sessions(spark.createDataFrame([], schema), key, gap).schema).parquet(f"{out}/sessions")
    return found, spark.read.schema(schema).parquet(f"{out}/late")
