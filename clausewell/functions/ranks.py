"""Exact order statistics without gathering a group: values are counted, binned and ranked inside one bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(fraction: float) -> str:
    """SQL for the 0-based rank that halves to even: round(fraction * (n - 1))."""
    return f"cast(bround({fraction}D * (n - 1)) as bigint)"


UPPER, LOWER = "n div 2", "(n - 1) div 2"


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, str], bins: int = 128) -> DataFrame:
    """One row per group with its n and the value at each rank, SQL over n, exact.

    Equal values are counted before any shuffle by rank. A group's distinct values are cut into ``bins`` of about as many
    each, however far its outliers lie, by bounds from a mergeable quantile sketch; the bins are then counted exactly, and
    only bins, and the distinct values of the bins that hold a wanted rank, are ordered together.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = ", ".join(f"{k / bins}D" for k in range(1, bins))
    bounds = counts.groupBy(F.col(group).alias("of")).agg(F.expr(f"array_distinct(percentile_approx(v, array({cuts}), {8 * bins}))").alias("bounds"))
    counts = counts.join(bounds, F.col(group).eqNullSafe(F.col("of")))
    counts = counts.select(group, "v", "c", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("bin"))
    sums = counts.groupBy(group, "bin").agg(F.sum("c").alias("in_bin"))
    sums = sums.withColumn("before", F.sum("in_bin").over(Window.partitionBy(group).orderBy("bin")) - F.col("in_bin"))
    sums = sums.withColumn("n", F.sum("in_bin").over(Window.partitionBy(group)))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), F.expr(r).alias("rank")) for k, r in ranks.items()))
    sums = sums.withColumn("wanted", F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("in_bin"))))
    chosen = sums.filter(F.size("wanted") > 0).withColumnsRenamed({group: "of", "bin": "at"})
    inside = counts.join(chosen, F.col(group).eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(group, "bin").orderBy("v"))
    each = inside.withColumn("upto", upto).select(group, "n", "v", "c", "upto", F.explode("wanted").alias("w"))
    hit = each.filter((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("c")))
    return hit.groupBy(group, "n").agg(*(F.max(F.when(F.col("w.name") == k, F.col("v"))).alias(k) for k in ranks))
