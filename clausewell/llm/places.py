"""Numbers rows in a total order, or inside the groups of one, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewell.llm.common import Scratch

#: Row numbers inside a task stand in the low bits of Spark's increasing ids.
_WITHIN = (1 << 33) - 1


def placed(rows: DataFrame, order: list[Column], scratch: Scratch, label: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in ``order`` inside their ``group``, and ``total``, its size.

    ``order`` begins with the group, which is never null. Ranges of the order are dealt to tasks and written in order
    with each row's number in its task; what is then summed over tasks is one row per task and group.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.withColumns({"_cw_part": F.spark_partition_id(), "_cw_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))})
    written = scratch.save(spread.withColumn("_cw_group", F.col(group) if group else F.lit(0)), label)
    parts = written.groupBy("_cw_group", "_cw_part").agg(F.count("*").alias("_cw_n"), F.min("_cw_at").alias("_cw_first"))
    line = Window.partitionBy("_cw_group").orderBy("_cw_part")
    parts = parts.withColumns({"_cw_upto": F.sum("_cw_n").over(line), "total": F.sum("_cw_n").over(Window.partitionBy("_cw_group"))})
    parts = parts.select("_cw_group", "_cw_part", (F.col("_cw_upto") - F.col("_cw_n") - F.col("_cw_first")).alias("_cw_shift"), "total")
    found = written.join(parts, ["_cw_group", "_cw_part"])
    return found.withColumn("place", F.col("_cw_at") + F.col("_cw_shift")).drop("_cw_group", "_cw_part", "_cw_at", "_cw_shift")
