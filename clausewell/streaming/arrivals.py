"""A table as a stream: its rows arrive in files that were written one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrive(rows: DataFrame, batch: str, folder: str) -> None:
    """Writes the rows below ``folder``, one file for each value of the column ``batch``, lowest first.

    The file source reads files by the time at which they were written, so each is written by a job of its own, and by one
    task, so that a micro-batch is one file. This replays a table; a stream that arrives by itself needs none of it.
    """
    numbers = sorted(r[0] for r in rows.select(batch).distinct().collect())
    for number in numbers:
        rows.filter(F.col(batch) == number).drop(batch).coalesce(1).write.mode("append").parquet(folder)


def stream(spark: SparkSession, schema, folder: str) -> DataFrame:
    """The arrived rows, one file a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(query) -> None:
    """Waits for a stream that reads what there is, and raises what went wrong in it."""
    query.awaitTermination()
    if error := query.exception():
        raise error
