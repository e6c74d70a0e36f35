"""Scans of documents as they arrive: every document becomes typed steps, the last of them always ``done``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.functions.text import mismatch
from clausewell.operators.scan import MOST_CHARS, MOST_CLAUSES, rule_judge
from clausewell.operators.splitting import split_clauses

STEP = "kind string, judged int, total int, index int, clause string, verdict string, document_state string"


def _step(kind: str, **given: Column) -> Column:
    fields = [F.lit(kind).alias("kind")]
    for field in STEP.split(", ")[1:]:
        name, type_name = field.split()
        fields.append(given.get(name, F.lit(None)).cast(type_name).alias(name))
    return F.struct(*fields)


def steps(docs: DataFrame, state: str = "wa", judge: Callable[[Column], Column] = rule_judge, most: int = MOST_CLAUSES, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, step (from 1) and STEP for rows (doc_id, text, gate, jurisdiction, insists), on a stream or a table, made inside each row.

    A text over the limit is ``too_large`` and one without clauses is ``no_text``. Else come ``split`` with the two
    counts; ``gate_refused`` for ``other`` (or a null gate) unless the user insists; ``gate_flagged`` for anything but a lease;
    ``jurisdiction`` where the document names another state; ``judging``; a ``clause`` for each judged one; and
    ``protections``. ``done`` ends every document, whatever came before.
    """
    large = F.coalesce(F.length("text"), F.lit(0)) > most_chars
    told = F.struct("doc_id", large.alias("large"), F.coalesce("gate", F.lit("other")).alias("gate"), "jurisdiction", F.coalesce("insists", F.lit(False)).alias("insists"))
    split = split_clauses(docs.select(told.alias("doc_id"), F.when(~large, F.col("text")).alias("text"))).select("doc_id.*", "clauses")
    total, judged = F.size("clauses"), F.least(F.size("clauses"), F.lit(most))
    refused = (F.col("gate") == "other") & ~F.col("insists")
    off = F.coalesce(mismatch(F.col("jurisdiction"), F.lit(state)), F.lit(False))
    each = F.transform(
        F.slice("clauses", 1, most), lambda c, k: _step("clause", judged=k + 1, total=judged, index=k + 1, clause=c, verdict=judge(c)))
    some = lambda condition, step: F.when(condition, F.array(step)).otherwise(F.array().cast(f"array<struct<{STEP.replace(' ', ':').replace(',:', ',')}>>"))
    scanned = ~refused
    line = F.concat(
        F.array(_step("split", judged=judged, total=total)), some(refused, _step("gate_refused", total=total)), some(scanned & (F.col("gate") != "lease_agreement"), _step("gate_flagged", total=total)),
        some(scanned & off, _step("jurisdiction", total=total, document_state=F.col("jurisdiction"))), some(scanned, _step("judging", judged=judged, total=total)),
        F.when(scanned, each).otherwise(some(F.lit(False), _step("clause"))), some(scanned, _step("protections", total=total)))
    line = F.when(F.col("large"), F.array(_step("too_large"))).when(total == 0, F.array(_step("no_text", total=total))).otherwise(line)
    ended = F.concat(line, F.array(_step("done", total=total, judged=F.when(scanned, judged).otherwise(0))))
    return split.select("doc_id", F.posexplode(ended).alias("at", "s")).select("doc_id", (F.col("at") + 1).alias("step"), "s.*")


ACCOUNT = "documents bigint, steps bigint, judged bigint, red bigint, status string"


def _account(rows: DataFrame, status: str) -> DataFrame:
    """One row over the steps of a batch."""
    counted = rows.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("steps"), F.count_if(F.col("kind") == "clause").alias("judged"), F.count_if(F.col("verdict") == "red").alias("red"))
    return counted.withColumn("status", F.lit(status))


def write_steps(docs: DataFrame, out: str, checkpoint: str, write=None, **options):
    """Starts the scan of a stream of documents: steps go to ``<out>/steps``, one accounting row per batch to ``<out>/accounts``.

    Both are kept by batch, so a batch that runs again replaces what it wrote before. The account is written last whatever
    happens: where writing the steps (``write(rows, folder)`` does it) fails, its status is ``failed`` until the batch succeeds.
    """
    spark = docs.sparkSession
    write = write or (lambda rows, folder: rows.write.mode("overwrite").parquet(folder))

    def sink(rows: DataFrame, batch: int) -> None:
        folder, status = f"{out}/steps/batch={batch}", "failed"
        try:
            write(rows, folder)
            status = "done"
        finally:
            # a finished batch is accounted from what was written, a failed one from the steps themselves
            source = spark.read.schema(rows.schema).parquet(folder) if status == "done" else rows
            _account(source, status).coalesce(1).write.mode("overwrite").parquet(f"{out}/accounts/batch={batch}")

    return steps(docs, **options).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
