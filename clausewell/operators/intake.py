"""Around a scan: what is let in, which protections are missing, which sections an answer may cite, and runs kept from earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.functions.text import first_mentions, mismatch, strip

#: Limits of an upload in bytes and of a question in characters.
MOST_BYTES, MOST_QUESTION = 8 << 20, 2000
#: The kinds of document that the gate tells, and the phrase that overrides its refusal.
LEASE, OTHER, OVERRIDE = "lease_agreement", "other", "scan anyway"


def upload_status(text: Column, most_bytes: int = MOST_BYTES) -> Column:
    """too_large, empty (null, or blanks alone) or accepted; a refused upload is a row, not an error."""
    return F.when(F.octet_length(text) > most_bytes, "too_large").when(strip(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("accepted")


def question_status(text: Column, most: int = MOST_QUESTION) -> Column:
    """Questions are refused beyond ``most`` characters and never cut."""
    return F.when(F.length(text) > most, "too_long").otherwise("accepted")


def overridden(said: Column) -> Column:
    return F.coalesce(F.contains(F.lower(said), F.lit(OVERRIDE)), F.lit(False))


def gate_decisions(checks: DataFrame, applied: str) -> DataFrame:
    """``checks`` (kind, jurisdiction, said) with status, gate_flagged and mismatch.

    Anything but a lease is flagged; ``other`` is refused unless what the user said overrides it. A null kind is ``other``.
    """
    kind = F.coalesce("kind", F.lit(OTHER))
    status = F.when((kind == OTHER) & ~overridden(F.col("said")), "refused").when(kind != LEASE, "flagged").otherwise("accepted")
    return checks.withColumns({"status": status, "gate_flagged": kind != LEASE, "mismatch": F.coalesce(mismatch(F.col("jurisdiction"), F.lit(applied)), F.lit(False))})


def missing_protections(checks: DataFrame, checklist: DataFrame) -> DataFrame:
    """(file, n_missing, missing): names of the checklist items (index, name) whose status is missing; indexes that it lacks are dropped."""
    named = checks.join(checklist, "index").withColumn("lost", F.when(F.col("status") == "missing", F.col("name")))
    return named.groupBy("file").agg(F.count("lost").alias("n_missing"), F.array_sort(F.collect_set("lost")).alias("missing"))


def cited_sections(answers: DataFrame, retrieved: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """``keys`` and the sections that an answer names and ``retrieved`` (``scope``, section) holds, in the order of their first
    mention. Answers without any have no row. A list is as long as one answer's mentions."""
    each = answers.select(*keys, F.posexplode(first_mentions(F.col("answer"))).alias("place", "section"))
    held = each.join(retrieved.select(scope, "section").distinct(), [scope, "section"], "left_semi").groupBy(*keys, "section").agg(F.min("place").alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "section")))
    return held.groupBy(*keys).agg(F.transform(ordered, lambda x: x["section"]).alias("sections"))


def kept_runs(old: DataFrame, new: DataFrame, provenance: str) -> DataFrame:
    """New runs beside all earlier ones (run, collection, summary, provenance, run_state).

    Earlier runs are superseded by their summaries; one that was current and has no provenance takes that of its file.
    """
    fields = ["run", "collection", "summary", "provenance"]
    own = F.when(F.col("run_state") == "current", F.coalesce("provenance", F.lit(provenance))).otherwise(F.col("provenance"))
    past = old.withColumn("provenance", own).select(*fields, F.lit("superseded").alias("run_state"))
    return past.unionByName(new.select(*fields, F.lit("current").alias("run_state")))
