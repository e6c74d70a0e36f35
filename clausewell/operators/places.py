"""Numbering of rows in a total order without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewell.sources.tables import shared_folder

#: The bits of Spark's increasing ids that number the rows of one task.
_IN_TASK = (1 << 33) - 1


def numbered_rows(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their number from 0 in ``order``. Rows are dealt to tasks by ranges of the order and written sorted, with
    their number in the task; what comes before a task's first row is then summed over tasks, one row each."""
    spark, where = rows.sparkSession, shared_folder(rows.sparkSession, "numbered")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.withColumns({"_cw_task": F.spark_partition_id(), "_cw_in": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))})
    sorted_rows.write.parquet(where)
    written = spark.read.schema(sorted_rows.schema).parquet(where)
    tasks = written.groupBy("_cw_task").agg(F.count("*").alias("n"), F.min("_cw_in").alias("first"))
    before = F.sum("n").over(Window.orderBy("_cw_task")) - F.col("n") - F.col("first")
    shifts = tasks.select("_cw_task", before.alias("_cw_before"))
    return written.join(shifts, "_cw_task").withColumn(name, F.col("_cw_before") + F.col("_cw_in")).drop("_cw_task", "_cw_in", "_cw_before")
