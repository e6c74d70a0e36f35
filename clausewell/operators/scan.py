"""The scan: clauses, gate, verdicts from a pluggable judge, and totals per document.

A judge is a function of a clause column that gives ``red``, ``yellow`` or ``green``; a model enters as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.operators.splitting import split_clauses

#: Limits of one document.
MOST_CHARS, MOST_CLAUSES = 384_000, 60
#: The default judge's rules, first match wins.
RULES = (("red", r"(?i)(waive|indemnif|password|secret|api[_-]?key)"), ("yellow", r"[0-9]{3,}|[#*$%&]{2,}"))


def rule_judge(clause: Column) -> Column:
    found = F.lit("green")
    for verdict, pattern in reversed(RULES):
        found = F.when(clause.rlike(pattern), verdict).otherwise(found)
    return found


def findings(docs: DataFrame, judge: Callable[[Column], Column] = rule_judge) -> DataFrame:
    """doc_id, index from 1, clause and verdict of every judged clause; documents over the size limit have none."""
    kept = split_clauses(docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS))
    rows = kept.select("doc_id", F.posexplode(F.slice("clauses", 1, MOST_CLAUSES)).alias("at", "clause"))
    return rows.select("doc_id", (F.col("at") + 1).alias("index"), "clause", judge(F.col("clause")).alias("verdict"))


def scan(docs: DataFrame, judge: Callable[[Column], Column] = rule_judge) -> DataFrame:
    """One row per document: status, mode, clauses in all, clauses judged, partial, and the counts of verdicts.

    Status is too_large, empty or scanned; nothing is raised for a document's content. Counting stays in the row.
    """
    sized = docs.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS, F.col("text")).alias("text"), (F.coalesce(F.length("text"), F.lit(0)) > MOST_CHARS).alias("large"))
    split = split_clauses(sized.select(F.struct("doc_id", "large").alias("doc_id"), "text"))
    judged = split.withColumn("verdicts", F.transform(F.slice("clauses", 1, MOST_CLAUSES), judge))
    total = F.size("clauses")
    status = F.when(F.col("doc_id.large"), "too_large").when(total == 0, "empty").otherwise("scanned")
    counts = [F.size(F.filter("verdicts", F.lit(v).eqNullSafe)).alias(v) for v in ("red", "yellow", "green")]
    return judged.select("doc_id.doc_id", status.alias("status"), "mode", total.alias("clauses_total"), F.size("verdicts").alias("clauses_judged"), (total > MOST_CLAUSES).alias("partial"), *counts)


def merged_protections(checks: DataFrame) -> DataFrame:
    """(doc_id, index, window, status): per item the status that weighs most, present over missing over not_applicable; ties keep the first window."""
    weight = F.when(F.col("status") == "present", 2).when(F.col("status") == "missing", 1).otherwise(0)
    best = F.max_by(F.struct("status", "window"), F.struct(weight.alias("w"), (-F.col("window")).alias("at")))
    return checks.groupBy("doc_id", "index").agg(best.alias("b")).select("doc_id", "index", "b.status", "b.window")
