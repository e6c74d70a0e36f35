"""Registered queries of intake, collections and the cache over a stream, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.operators import intake
from clausewell.plans.engine import Engine
from clausewell.sources import collections
from clausewell.sources.tables import shared_folder, table
from clausewell.streaming import cache
from clausewell.study_queries import _TURNS, turns

#: Bounds that the given texts reach.
BYTES, QUESTION = 8192, 1000
CHECKLIST = ("deposit", "heat", "notice", "repair", "water")


def upload_statuses(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", intake.upload_status(text, BYTES).alias("upload"), intake.question_status(text, QUESTION).alias("question"))


def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as classified documents; every second one's user insists."""
    size = F.col("size")
    checks = turns(spark, d).select(
        "file", "index", F.when(size % 4 == 0, "other").when(size % 4 == 1, "guide").otherwise("lease_agreement").alias("kind"),
        F.when(size % 3 == 0, "WA").when(size % 3 == 1, "CA").otherwise("unknown").alias("jurisdiction"), F.when(F.col("index") % 2 == 0, "Please SCAN anyway").otherwise(F.col("text")).alias("said"))
    return intake.gate_decisions(checks, "wa").select("file", "index", "status", "gate_flagged", "mismatch")


def missing_protections(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("size") % 3 == 0, "present").when(F.col("size") % 3 == 1, "missing").otherwise("not_applicable")
    items = spark.createDataFrame(list(enumerate(CHECKLIST, 1)), "index int, name string")
    found = intake.missing_protections(turns(spark, d).select("file", "index", status.alias("status")), items)
    return found.withColumn("missing", F.array_join("missing", ","))


def cited_sections(spark: SparkSession, d: str) -> DataFrame:
    """What a turn cites, of the sections that the turns of even length retrieved."""
    found = turns(spark, d)
    answers = found.select("file", "index", F.concat_ws(" and ", F.array_join("citations", " "), "section").alias("answer"))
    kept = intake.cited_sections(answers, found.filter("size % 2 = 0").select("file", "section"), ["file", "index"], "file")
    return kept.withColumn("sections", F.array_join("sections", ","))


def kept_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events of even users as earlier runs, of odd ones as new runs."""
    u = F.col("user_id")
    runs = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("run"), F.col("event_type").alias("collection"), F.col("value").alias("summary"),
        F.when(u % 4 == 0, "measured").alias("provenance"), F.when(F.col("event_id") % 3 == 0, "superseded").otherwise("current").alias("run_state"))
    return intake.kept_runs(runs.filter("user_id % 2 = 0"), runs.filter("user_id % 2 = 1"), "earlier file")


def exported_collection(spark: SparkSession, d: str) -> DataFrame:
    """All chunks as a collection, rebuilt, exported and read back."""
    root = shared_folder(spark, "collection")
    collections.rebuild(Engine(table(spark, d, "documents")).ingest("wa").select("chunk_id", "doc_id", "content"), f"{root}/source")
    return collections.export(spark, f"{root}/source", f"{root}/target").select("chunk_id", "ord", "doc_id", F.md5("content").alias("digest"))


def recent_users(spark: SparkSession, d: str) -> DataFrame:
    return cache.replay_recent(spark, d)


NAMES = (upload_statuses, gate_decisions, missing_protections, cited_sections, kept_runs, exported_collection, recent_users)
QUERIES = {f.__name__: f for f in NAMES}

_ITEMS = ", ".join(f"({k}, '{name}')" for k, name in enumerate(CHECKLIST, 1))
ORACLES = {
    "upload_statuses": f"""select doc_id, case when strlen(text) > {BYTES} then 'too_large' when regexp_matches(coalesce(text, ''), '^\\s*$') then 'empty' else 'accepted' end as upload,
        case when length(text) > {QUESTION} then 'too_long' else 'accepted' end as question from documents""",
    "gate_decisions": f"""with {_TURNS}, g as (select file, index, case size % 4 when 0 then 'other' when 1 then 'guide' else 'lease_agreement' end as kind, size % 3 = 1 as mismatch,
          contains(lower(if(index % 2 = 0, 'Please SCAN anyway', coalesce(text, ''))), 'scan anyway') as insists from t)
        select file, index, case when kind = 'other' and not insists then 'refused' when kind <> 'lease_agreement' then 'flagged' else 'accepted' end as status, kind <> 'lease_agreement' as gate_flagged, mismatch from g""",
    "missing_protections": f"""with {_TURNS}, c as (select file, name, size % 3 = 1 as lost from t join (values {_ITEMS}) as i(index, name) using (index))
        select file, count_if(lost) as n_missing, coalesce(string_agg(distinct name, ',' order by name) filter (lost), '') as missing from c group by file""",
    "cited_sections": f"""with {_TURNS}, x as (select file, index, regexp_extract_all(array_to_string(citations, ' ') || ' and ' || section, 'RCW \\d+\\.\\d+\\.\\d+') as s from t),
        m as (select file, index, unnest(s) as section, generate_subscripts(s, 1) as place from x), f as (select file, index, section, min(place) as place from m group by all),
        r as (select distinct file, section from t where size % 2 = 0)
        select file, index, string_agg(section, ',' order by place) as sections from f semi join r using (file, section) group by file, index""",
    "kept_runs": """select event_id as run, event_type as collection, value as summary,
        case when user_id % 4 = 0 then 'measured' when user_id % 2 = 0 and event_id % 3 <> 0 then 'earlier file' end as provenance, if(user_id % 2 = 0, 'superseded', 'current') as run_state from events""",
    "exported_collection": """with c as (select doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 1000) / 800))::bigint)) as k from documents where length(text) > 0),
        n as (select *, row_number() over (order by doc_id, k) - 1 as ord from c)
        select 'wa-' || ord as chunk_id, ord, doc_id, md5(substring(text, k * 800 + 1, 1000)) as digest from n""",
    "recent_users": "select user_id, max(ts) as last_used from events group by user_id order by last_used desc, user_id limit 32",
}
