"""Intake, collections and manifests on small hand-made rows; the registered queries are held against SQL elsewhere."""

import json

from pyspark.sql import functions as F

from clausewell.operators import findings, intake
from clausewell.sources import collections


def test_upload_and_question_bounds(spark):
    rows = spark.createDataFrame([(1, "é" * 5), (2, "x" * 10), (3, "x" * 11), (4, " \n "), (5, None)], "id int, text string")
    found = rows.select("id", intake.upload_status(F.col("text"), 10).alias("u"), intake.question_status(F.col("text"), 10).alias("q")).collect()
    assert {r.id: (r.u, r.q) for r in found} == {
        1: ("accepted", "accepted"), 2: ("accepted", "accepted"), 3: ("too_large", "too_long"), 4: ("empty", "accepted"), 5: ("empty", "accepted")}


def test_gate(spark):
    rows = spark.createDataFrame(
        [(1, "other", "WA", None), (2, "other", "CA", "do Scan Anyway"), (3, "guide", "unknown", ""), (4, "lease_agreement", "ca", None), (5, None, None, "hello")],
        "id int, kind string, jurisdiction string, said string")
    found = {r.id: (r.status, r.gate_flagged, r.mismatch) for r in intake.gate_decisions(rows, "wa").collect()}
    assert found == {
        1: ("refused", True, False), 2: ("flagged", True, True), 3: ("flagged", True, False), 4: ("accepted", False, True), 5: ("refused", True, False)}


def test_protections_citations_and_runs(spark):
    checks = spark.createDataFrame([(1, 1, "missing"), (1, 2, "present"), (1, 9, "missing"), (2, 2, "not_applicable")], "file int, index int, status string")
    items = spark.createDataFrame([(1, "heat"), (2, "water")], "index int, name string")
    assert {r.file: (r.n_missing, r.missing) for r in intake.missing_protections(checks, items).collect()} == {1: (1, ["heat"]), 2: (0, [])}
    answers = spark.createDataFrame([(1, "See RCW 1.2.9, RCW 1.2.3(1), RCW 1.2.9 and RCW 7.7.7."), (2, "nothing"), (3, None)], "q int, answer string")
    held = spark.createDataFrame([(1, "RCW 1.2.3"), (1, "RCW 1.2.9"), (1, "RCW 1.2.9"), (2, "RCW 7.7.7")], "q int, section string")
    assert [(r.q, r.sections) for r in intake.cited_sections(answers, held, ["q"], "q").collect()] == [(1, ["RCW 1.2.9", "RCW 1.2.3"])]
    old = spark.createDataFrame([(1, "a", 0.5, None, "current"), (2, "a", 0.6, None, "superseded")], "run int, collection string, summary double, provenance string, run_state string")
    new = spark.createDataFrame([(3, "b", 0.7, "now")], "run int, collection string, summary double, provenance string")
    assert sorted(map(tuple, intake.kept_runs(old, new, "file").collect())) == [
        (1, "a", 0.5, "file", "superseded"), (2, "a", 0.6, None, "superseded"), (3, "b", 0.7, "now", "current")]


def test_collections_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([(f"wa-{k}", "S" if k % 2 else "T", str(k)) for k in range(12)], "chunk_id string, section string, content string")
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/target"
    collections.rebuild(chunks, source)
    collections.rebuild(chunks.filter("chunk_id <> 'wa-0'"), source)
    assert collections.read(spark, source, "S", ["chunk_id"]).count() == 6
    assert "PushedFilters: [IsNotNull(section), EqualTo(section,S)]" in collections.read(spark, source, "S")._jdf.queryExecution().toString()
    out = collections.export(spark, source, target)
    assert [r.content for r in out.orderBy("ord").collect()] == [str(k) for k in range(1, 12)]
    text = {"_comment": "x", "leases": [{"file": "a", "red": {"3": ["RCW 1.2.3"], "12": []}, "missing_protections": ["heat"]}, {"file": "b", "category": "clean", "red": {}}]}
    (tmp_path / "manifest.json").write_text(json.dumps(text, indent=1))
    docs = collections.manifest(spark, f"file://{tmp_path}/manifest.json")
    assert sorted((r.file, r.category) for r in docs.collect()) == [("a", None), ("b", "clean")]
    labels = collections.planted(docs)
    assert sorted((r.file, r.number, r.accepted) for r in labels.collect()) == [("a", 3, ["RCW 1.2.3"]), ("a", 12, [])]
    found = spark.createDataFrame([("a", 1, "3. No heat.", "red", ["RCW 1.2.3(1)"])], "file string, index int, clause string, verdict string, citations array<string>")
    assert findings.clause_scores(found, labels).first().hit
