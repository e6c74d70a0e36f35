"""Registered queries over streams and over the index that is kept up to date, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.operators import retrieval
from clausewell.operators.segments import SegmentedIndex
from clausewell.queries import _ASKED, _CLAUSES, _JUDGED, _bm25
from clausewell.sources.tables import shared_folder, table
from clausewell.streaming import arrivals, lru, scans, sessions

#: Files in which a table arrives; one more brings what comes late.
FILES = 4
TTL = 86_400.0


def updated_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """An index of older documents (some changed since, some new, some gone) is updated in two steps and merged; then it is searched."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 97 <> 3").withColumn("text", F.when(F.col("doc_id") % 101 == 0, F.concat(F.lit("older words "), "text")).otherwise(F.col("text")))
    index = SegmentedIndex(spark, shared_folder(spark, "segments"), ["doc_id"])
    index.update(old.union(spark.createDataFrame([(-1, "gone since")], "doc_id bigint, text string")))
    index.update(docs.filter("doc_id % 97 <> 3 or doc_id % 2 = 0"))
    index.update(docs)
    index.merge(2)
    hits = retrieval.search(index.index(), table(spark, d, "benchmark"), "item_id", 5)
    return hits.select("item_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def index_updates(spark: SparkSession, d: str) -> DataFrame:
    """What each version of that index wrote."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = SegmentedIndex(spark, shared_folder(spark, "segments"), ["doc_id"])
    index.update(docs.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("x"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))))
    index.update(docs)
    return index.live().groupBy("segment").agg(F.count("*").alias("documents"), F.sum("length").alias("terms"))


def cache_uses(spark: SparkSession, d: str) -> DataFrame:
    """Events use the key of their properties in one of three caches."""
    events = table(spark, d, "events").select(
        F.concat(F.lit("cache-"), (F.col("user_id") % 3).cast("string")).alias("cache"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    events = events.withColumns({"at": (F.col("at") / 1e6).cast("double")})
    out = shared_folder(spark, "cache-uses")
    n = events.count()
    arrivals.arrive(events.withColumn("batch", F.floor(F.col("seq") * FILES / n)), "batch", f"{out}/in")
    with lru.map_state(spark):
        query = lru.uses(arrivals.stream(spark, events.schema, f"{out}/in"), ttl=TTL).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
        arrivals.drained(query.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")).start())
    return spark.read.schema(lru.USE).parquet(f"{out}/rows").select("cache", "seq", "key", "hit", "entries")


def _late_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    n = events.count()
    batch = F.when(F.col("event_id") % 97 == 0, FILES).otherwise(F.floor(F.col("event_id") * FILES / n))
    dealt = events.withColumn("batch", batch.cast("int"))
    # a last row from nobody, a day on, moves the watermark past all sessions
    end = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(None).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("bigint").alias("user_id"), F.lit(0.0).alias("value"), F.lit(FILES + 1).alias("batch"))
    out = shared_folder(spark, "sessions")
    arrivals.arrive(dealt.unionByName(end), "batch", f"{out}/in")
    return sessions.run(spark, events.schema, f"{out}/in", out, "user_id")


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _late_events(spark, d)
    return found.filter("user_id is not null").select("user_id", "session_start", "session_end", "n", F.round("total", 4).alias("total"))


def late_events(spark: SparkSession, d: str) -> DataFrame:
    _, late = _late_events(spark, d)
    return late.select("event_id", "user_id", "ts")


def _scanned(spark: SparkSession, d: str) -> str:
    """Documents arrive and are scanned; their gate and state follow from their number. The folder of what was written."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        "doc_id", "text", F.when(k % 5 == 0, "other").when(k % 7 == 0, "document_about_leases").otherwise("lease_agreement").alias("gate"), F.when(k % 3 == 0, "CA").when(k % 3 == 1, "WA").alias("jurisdiction"), (k % 10 == 0).alias("insists"))
    out = shared_folder(spark, "scan-steps")
    arrivals.arrive(docs.withColumn("batch", k % FILES), "batch", f"{out}/in")
    arrivals.drained(scans.write_steps(arrivals.stream(spark, docs.schema, f"{out}/in"), out, f"{out}/state"))
    return out


def scan_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.schema("doc_id bigint, step int, " + scans.STEP).parquet(f"{_scanned(spark, d)}/steps")
    return rows.select("doc_id", "step", "kind", "judged", "total", F.md5("clause").alias("digest"), "verdict", "document_state")


def scan_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The accounts of the same stream, one per batch of arrived documents."""
    return spark.read.schema(scans.ACCOUNT + ", batch int").parquet(f"{_scanned(spark, d)}/accounts")


NAMES = (updated_index_topk, index_updates, cache_uses, user_sessions, late_events, scan_steps, scan_accounts)
QUERIES = {f.__name__: f for f in NAMES}

_LATE = f"""e as (select event_id, ts, user_id, value, if(event_id % 97 = 0, {FILES}, event_id * {FILES} // (select count(*) from events)) as batch from events),
w as (select max(ts) - interval 2 hours as mark from e where batch < {FILES - 1}), l as (select * from e, w where batch = {FILES} and ts + interval 30 minutes <= mark), k as (select * from e anti join l using (event_id))"""


def _sessions(name: str, rows: str) -> str:
    """Clauses of a WITH that end in ``<name>_g``: the rows with the number of their session among the user's."""
    return f"""{name}_s as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes, true) as begins from ({rows})),
{name}_g as (select event_id, ts, user_id, value, batch, sum(begins::int) over (partition by user_id order by ts rows unbounded preceding) as session from {name}_s)"""


_WORDS = "len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\\.[a-z0-9]+)*'), lambda x: length(x) > 1))"
#: Clauses of a WITH that end in ``s``: the steps of all documents, ordered by a and b.
_STEPS = f"""{_CLAUSES}, g as (select doc_id, clauses, len(clauses) as n, least(len(clauses), 60) as j, doc_id % 5 = 0 and doc_id % 10 <> 0 as refused, doc_id % 5 <> 0 and doc_id % 7 = 0 or doc_id % 10 = 0 as flagged,
          doc_id % 3 = 0 as off, length(text) > 384000 as large from k join (select doc_id, text from documents) using (doc_id)),
        s as (select doc_id, 1 as a, 0 as b, case when large then 'too_large' when n = 0 then 'no_text' else 'split' end as kind, if(large or n = 0, null, j) as judged, if(large, null, n) as total, null as c, null as document_state from g
          union all select doc_id, 2, 0, 'gate_refused', null, n, null, null from g where not large and n > 0 and refused
          union all select doc_id, 3, 0, 'gate_flagged', null, n, null, null from g where not large and n > 0 and not refused and flagged
          union all select doc_id, 4, 0, 'jurisdiction', null, n, null, 'CA' from g where not large and n > 0 and not refused and off
          union all select doc_id, 5, 0, 'judging', j, n, null, null from g where not large and n > 0 and not refused
          union all select doc_id, 6, generate_subscripts(clauses[1:60], 1), 'clause', generate_subscripts(clauses[1:60], 1), j, unnest(clauses[1:60]), null from g where not large and n > 0 and not refused
          union all select doc_id, 7, 0, 'protections', null, n, null, null from g where not large and n > 0 and not refused
          union all select doc_id, 8, 0, 'done', if(refused or large, 0, j), if(large, 0, n), null, null from g)"""
ORACLES = {
    "updated_index_topk": f"with {_bm25(_ASKED, 'item_id', 'select doc_id, text from documents', 'doc_id', 5)} select item_id, doc_id, rank, round(score, 5) as score from hits",
    "index_updates": f"select if(doc_id % 100 = 0, 2, 1) as segment, count(*) as documents, sum({_WORDS}) as terms from documents group by 1",
    "cache_uses": f"""with u as (select 'cache-' || user_id % 3 as cache, event_id as seq, regexp_extract(props, '[0-9]+') as key, ts from events),
        p as (select *, lag(seq) over (partition by cache, key order by seq) as prev, lag(ts) over (partition by cache, key order by seq) as prev_ts, coalesce(lead(seq) over (partition by cache, key order by seq), 1e18::bigint) as next from u),
        n as (select a.cache, a.seq, count(b.seq) as between_uses from p a left join p b on b.cache = a.cache and b.seq > a.prev and b.seq < a.seq and b.next >= a.seq group by all),
        f as (select cache, seq, least(32, sum(if(prev is null, 1, 0)) over (partition by cache order by seq)) as entries from p)
        select cache, seq, key, coalesce(between_uses < 32 and epoch_us(ts) - epoch_us(prev_ts) <= {int(TTL * 1e6)}, false) and prev is not null as hit, entries::int as entries from p join n using (cache, seq) join f using (cache, seq)""",
    # sessions that had been emitted when the late rows came stay as they are; the others go on together with these
    "user_sessions": f"""with {_LATE}, {_sessions('a', f'select * from k where batch < {FILES}')}, c as (select user_id, session, min(ts) as first, max(ts) as last from a_g group by all),
        o as (select a_g.* from a_g join c using (user_id, session), w where last + interval 30 minutes > mark), {_sessions('b', f'select event_id, ts, user_id, value, batch from o union all select event_id, ts, user_id, value, batch from k where batch = {FILES}')},
        r as (select *, 0 as part from a_g where event_id not in (select event_id from o) union all select *, 1 from b_g)
        select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n, round(sum(value), 4) as total from r group by user_id, session, part""",
    "late_events": f"with {_LATE} select event_id, user_id, ts from l",
    "scan_steps": f"""with {_STEPS} select doc_id, row_number() over (partition by doc_id order by a, b) as step, kind, judged, total, md5(c) as digest, if(c is null, null, {_JUDGED}) as verdict, document_state from s""",
    "scan_accounts": f"""with {_STEPS} select (doc_id % {FILES})::int as batch, count(distinct doc_id) as documents, count(*) as steps, count_if(kind = 'clause') as judged, count_if(kind = 'clause' and {_JUDGED} = 'red') as red, 'done' as status from s group by 1""",
}
