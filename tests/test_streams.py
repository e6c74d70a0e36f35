"""Streams in several batches: the cache as bounded state, sessions with late rows, scans that survive a failing sink; and the index kept up to date."""

from collections import OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewell.operators import retrieval
from clausewell.operators.segments import SegmentedIndex
from clausewell.streaming import arrivals, lru, scans, sessions

USES = "cache string, seq bigint, key string, at double, batch int"


def cached(spark, rows, path, **options):
    uses = spark.createDataFrame(rows, USES)
    arrivals.arrive(uses, "batch", f"{path}/in")
    with lru.map_state(spark):
        stream = lru.uses(arrivals.stream(spark, uses.drop("batch").schema, f"{path}/in"), **options)
        arrivals.drained(stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
                         .foreachBatch(lambda found, batch: found.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")).start())
    return {r.seq: (r.hit, r.evicted, r.entries) for r in spark.read.schema(lru.USE).parquet(f"{path}/rows").collect()}


def replayed(rows, most, ttl):
    held, out = {}, {}
    for cache, seq, key, at, _ in sorted(rows, key=lambda r: r[1]):
        one = held.setdefault(cache, OrderedDict())
        last = one.pop(key, None)
        one[key] = at
        evicted = one.popitem(last=False)[0] if len(one) > most else None
        out[seq] = (last is not None and (ttl is None or at - last <= ttl), evicted, len(one))
    return out


@pytest.mark.parametrize("ttl", [None, 25.0])
def test_the_cache_equals_a_replay(spark, tmp_path, ttl):
    rng = np.random.default_rng(5)
    rows = [(f"c{k % 2}", k, f"k{int(rng.zipf(1.4)) % 40}", float(k), k * 3 // 400) for k in range(400)]
    found = cached(spark, rows, f"file://{tmp_path}", most=8, ttl=ttl)
    assert found == replayed(rows, 8, ttl)
    assert max(n for _, _, n in found.values()) == 8 and {h for h, _, _ in found.values()} == {True, False}


SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Every row is in one session or among the late ones; a session that was emitted is not emitted again."""
    noon = datetime(2024, 1, 1, 12)
    rows = [(0, noon, 1, 1.0, 0), (1, noon + timedelta(minutes=20), 1, 2.0, 0), (2, noon + timedelta(hours=5), 1, 3.0, 1), (3, noon + timedelta(hours=9), 2, 4.0, 2)]
    rows += [(4, noon + timedelta(minutes=10), 1, 5.0, 3), (5, noon + timedelta(hours=8, minutes=50), 2, 6.0, 3), (6, noon + timedelta(days=2), None, 0.0, 4)]
    events = spark.createDataFrame(rows, SCHEMA + ", batch int")
    path = f"file://{tmp_path}"
    arrivals.arrive(events, "batch", f"{path}/in")
    found, late = sessions.run(spark, events.drop("batch").schema, f"{path}/in", path, "user_id")
    assert {r.event_id for r in late.collect()} == {4}
    got = {(r.user_id, r.session_start, r.session_end, r.n, r.total) for r in found.collect()}
    gap = timedelta(minutes=30)
    assert got == {(1, noon, noon + timedelta(minutes=20) + gap, 2, 3.0), (1, rows[2][1], rows[2][1] + gap, 1, 3.0), (2, rows[5][1], rows[3][1] + gap, 2, 10.0)}


def documents(spark):
    long = "\n\n".join(f"{k}. A clause of the lease that is about number {k} and says that the tenant will waive claims." for k in range(1, 5))
    return spark.createDataFrame(
        [(1, long, "lease_agreement", "WA", False, 0), (2, long, "other", None, False, 0), (3, long, "other", "CA", True, 1), (4, "", "lease_agreement", "CA", False, 1), (5, "x" * 5000, None, None, True, 2), (6, None, "guide", None, None, 2)],
        "doc_id bigint, text string, gate string, jurisdiction string, insists boolean, batch int")


def kinds(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.step)):
        out.setdefault(r.doc_id, []).append(r.kind)
    return out


EXPECTED = {
    1: ["split", "judging", "clause", "clause", "clause", "protections", "done"], 2: ["split", "gate_refused", "done"],
    3: ["split", "gate_flagged", "jurisdiction", "judging", "clause", "clause", "clause", "protections", "done"], 4: ["no_text", "done"], 5: ["too_large", "done"], 6: ["no_text", "done"]}


def test_steps(spark):
    found = scans.steps(documents(spark).drop("batch"), most=3, most_chars=4000)
    assert kinds(found) == EXPECTED
    first = found.filter("doc_id = 1").orderBy("step").collect()
    assert (first[0].judged, first[0].total, first[-1].judged, first[-1].total) == (3, 4, 3, 4)
    assert [(r.judged, r["index"], r.verdict) for r in first if r.kind == "clause"] == [(1, 1, "red"), (2, 2, "red"), (3, 3, "red")]
    assert found.filter("kind = 'jurisdiction'").first().document_state == "CA"


def test_a_failed_batch_leaves_no_second_row(spark, tmp_path):
    """The sink fails after it has written; the restarted stream runs the batch again and replaces its rows."""
    path, docs = f"file://{tmp_path}", documents(spark)
    arrivals.arrive(docs, "batch", f"{path}/in")
    stream = arrivals.stream(spark, docs.drop("batch").schema, f"{path}/in")
    failed = []

    def write(rows, folder):
        rows.write.mode("overwrite").parquet(folder)
        if folder.endswith("batch=1") and not failed:
            failed.append(folder)
            raise OSError("lost after the write")

    accounts = lambda: {r.batch: (r.documents, r.judged, r.red, r.status) for r in spark.read.schema(scans.ACCOUNT + ", batch int").parquet(f"{path}/accounts").collect()}
    with pytest.raises(Exception, match="lost after the write"):
        arrivals.drained(scans.write_steps(stream, path, f"{path}/state", write, most=3, most_chars=4000))
    assert accounts() == {0: (2, 3, 3, "done"), 1: (2, 3, 3, "failed")}
    arrivals.drained(scans.write_steps(stream, path, f"{path}/state", write, most=3, most_chars=4000))
    rows = spark.read.schema("doc_id bigint, step int, " + scans.STEP).parquet(f"{path}/steps")
    assert len(failed) == 1 and kinds(rows) == EXPECTED
    assert accounts() == {0: (2, 3, 3, "done"), 1: (2, 3, 3, "done"), 2: (2, 0, 0, "done")}


def test_an_update_writes_what_changed(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 37).cast("string"), F.lit(" heat")).alias("text"))
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", ["doc_id"])
    assert index.live() is None and index.update(docs) == {"added": 500, "changed": 0, "removed": 0, "kept": 0}
    later = docs.filter("doc_id <> 7").withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.lit("heat water heat")).otherwise(F.col("text"))).union(spark.createDataFrame([(900, None)], "doc_id bigint, text string"))
    assert index.update(later) == {"added": 1, "changed": 5, "removed": 1, "kept": 494}
    assert spark.read.parquet(f"{index.path}/segment-2").count() == 6
    assert index.update(later) == {"added": 0, "changed": 0, "removed": 0, "kept": 500} and index.version().segments == (1, 2)
    again = docs.filter("doc_id < 490")
    index.update(again)
    asked = spark.createDataFrame([(1, "heat water"), (2, "word5 word36")], "item_id bigint, text string")
    rows = lambda found: sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    want = rows(retrieval.bm25(asked, again, "item_id", ["doc_id"], 10))
    assert rows(retrieval.search(index.index(), asked, "item_id", 10)) == want
    assert index.merge(2) == 2 and len(index.version().segments) == 2 and index.merge(2) == 0
    assert rows(retrieval.search(index.index(), asked, "item_id", 10)) == want
    # an update that broke off before its log row is not seen
    (spark.createDataFrame([], "doc_id bigint, digest string, length int, counts array<struct<term:string,tf:int>>")).write.parquet(f"{index.path}/segment-99")
    assert index.live().count() == 490
