"""Metrics over results: retrieval, classification with subtotals, agreement, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """MRR, nDCG and hit rates of one ``rank`` per query, null where the target never arrived."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    hit = lambda k: rate((F.col("rank") <= k).cast("double"))
    return ranks.agg(F.count("*").alias("n"), rate(1.0 / F.col("rank")).alias("mrr"), rate(1.0 / F.log2(F.col("rank") + 1.0)).alias("ndcg"),
                     hit(1).alias("hit_1"), hit(5).alias("hit_5"), hit(10).alias("hit_10"))


def classification_metrics(rows: DataFrame, group: str) -> DataFrame:
    """Counts, precision and recall of ``flagged`` against ``expected`` per group and over all (null group)."""
    yes = lambda c: F.sum(c.cast("bigint"))
    table = rows.rollup(group).agg(
        F.count("*").alias("n"), yes(F.col("flagged") & F.col("expected")).alias("found"), yes(F.col("flagged") & ~F.col("expected")).alias("false_flags"),
        yes(~F.col("flagged") & F.col("expected")).alias("missed"))
    flagged, planted = F.col("found") + F.col("false_flags"), F.col("found") + F.col("missed")
    return table.withColumn("precision", F.round(F.when(flagged == 0, 1.0).otherwise(F.col("found") / flagged), 4)).withColumn(
        "recall", F.round(F.when(planted > 0, F.col("found") / planted), 4))


def kappa(rows: DataFrame, one: str, two: str) -> DataFrame:
    """n, agreement, expected agreement and Cohen's kappa (null without rows, or when chance agreement is complete)."""
    pairs = rows.filter(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).count()
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("count").alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("x"), F.col("count").alias("y")))).alias("e")).select("e.*")
    chance = each.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg((F.sum(F.col("x") * F.col("y"))).alias("xy"))
    seen = pairs.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    joined = seen.crossJoin(chance).select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.col("same") / F.col("n")).alias("po"), (F.col("xy") / (F.col("n").cast("double") * F.col("n"))).alias("pe"))
    return joined.select("n", F.round("po", 6).alias("agreement"), F.round("pe", 6).alias("chance"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def votes(rows: DataFrame, key: str) -> DataFrame:
    """key, agreed, repeats and status: pass where all repeats agreed, fail where none did, else flapping."""
    counts = rows.groupBy(key).agg(F.sum(F.col("agreed").cast("bigint")).alias("agreed"), F.count("*").alias("repeats"))
    return counts.withColumn("status", F.when(F.col("agreed") == F.col("repeats"), "pass").when(F.col("agreed") == 0, "fail").otherwise("flapping"))


def votes_by_kind(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """kind, questions and how many of them pass, fail or flap; a key belongs to one kind."""
    kinds = rows.groupBy(key).agg(F.min(kind).alias(kind))
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return votes(rows, key).join(kinds, key).groupBy(kind).agg(F.count("*").alias("questions"), status("pass"), status("fail"), status("flapping"))


def error_bound(wrong, n):
    """Upper bound of an error rate: 3 / n without errors, else the normal bound of 95 per cent."""
    p = wrong / n
    return F.when(wrong == 0, 3.0 / n).otherwise(p + 1.96 * F.sqrt(p * (1 - p) / n))


def corpus_changes(live: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """key and change: added, removed, changed or same, by the SHA-256 of the texts. Null text is the empty text."""
    side = lambda df, name: df.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))
    both = side(live, "new").join(side(committed, "old"), key, "full_outer")
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same").alias("change"))


def partitioned(rows: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are kept and the others; a null verdict keeps nothing, so that every row is on one side."""
    good = F.coalesce(kept, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def reviewed(reviews: DataFrame, cases: DataFrame, question: str = "question") -> DataFrame:
    """Reviews with the case of their question; reviews of unknown questions go, and of repeated cases the smallest id counts."""
    one = cases.groupBy(question).agg(F.min_by(F.struct(*[c for c in cases.columns if c != question]), "case_id").alias("case"))
    return reviews.join(one, question).select(*reviews.columns, "case.*")


def answer_order() -> list[Column]:
    """The order of a list of judged answers: those that are not consistent first, then by section."""
    return [F.when(F.col("verdict").eqNullSafe("consistent"), 1).otherwise(0), F.asc_nulls_first("section")]


def stage_costs(calls: DataFrame, key: str, stage: str, tokens: str, last: str) -> DataFrame:
    """Tokens of each ``key``: in all, before the stage ``last``, and of that stage, the difference of the two."""
    sums = calls.groupBy(key).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~F.col(stage).eqNullSafe(last), F.col(tokens))), F.lit(0)).alias("before"))
    return sums.withColumn("own", F.col("total") - F.col("before"))
