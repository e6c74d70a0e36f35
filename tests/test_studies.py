"""Small hand-made cases of scoring, studies, corpus building, log summaries and the engine's stages."""

import pytest
from pyspark.sql import functions as F

from clausewell.functions import text as T
from clausewell.functions.ranks import at_ranks, nearest
from clausewell.operators import corpus, findings, logs, studies
from clausewell.plans.engine import Engine, RetrievalConfig


def test_outcomes_and_document_scores(spark):
    found = spark.createDataFrame([
        (1, "3. Late fee", "red", ["RCW 59.18.230(2)(a)"]), (1, "4) Entry", "yellow", []), (1, "5. Pets", "green", []), (1, "6. Rent", "red", []), (1, "No number", "red", []),
        (1, "7. Heat", "yellow", []), (2, "3. Late", "green", [])], "file int, clause string, verdict string, citations array<string>")
    planted = spark.createDataFrame([(1, 3, ["RCW 59.18.230"]), (1, 4, ["RCW 59.18.060"]), (1, 5, ["RCW 1.2.3"]), (2, 3, ["RCW 1.2.3"])], "file int, number int, accepted array<string>")
    docs = spark.createDataFrame([(1, "a", False, ["heat"], ["heat"]), (2, "a", True, ["heat"], ["heat"]), (3, "b", False, [], [])], "file int, category string, refused boolean, expected_missing array<string>, reported_missing array<string>")
    clauses = findings.clause_scores(found, planted)
    assert {(r.clause[:2], r.outcome) for r in clauses.filter("file = 1").collect()} == {("3.", "flagged_red"), ("4)", "flagged_yellow"), ("5.", "missed"), ("6.", "false_red"), ("No", "clear"), ("7.", "unplanted_yellow")}
    rows = {r.file: r for r in findings.document_scores(docs, clauses, planted).collect()}
    assert (rows[1].flagged_red, rows[1].missed, rows[1].citation_hits, rows[1].protections_exact) == ([3], [5], 1, True)
    assert (rows[2].missed, rows[2].clauses_judged, rows[2].protections_exact, rows[3].planted) == ([3], 0, False, [])
    table = {r.category: r for r in findings.score_summary(findings.document_scores(docs, clauses, planted), "category").collect()}
    assert (table["a"].strict_recall, table["a"].lenient_recall, table["a"].precision, table["a"].rejected) == (0.25, 0.5, 0.5, 1)
    assert (table["b"].strict_recall, table["b"].precision, table[None].documents) == (None, 1.0, 3)


def test_flags_urls_and_claims(spark):
    flags = spark.createDataFrame([(1, 2, "yellow", ["RCW 1.2.3(a)"], 1), (1, 2, "red", ["RCW 1.2.3"], 2), (1, 2, "green", ["RCW 4.5.6"], 3)], "file int, number int, verdict string, citations array<string>, position int")
    row = findings.merged_flags(flags).first()
    assert (row.verdict, row.citations) == ("red", ["RCW 1.2.3", "RCW 4.5.6"])
    cited = spark.createDataFrame([(1, 1, ["RCW 1.2.3(a)", "RCW 7.7.7"])], "file int, clause_no int, citations array<string>")
    chunks = spark.createDataFrame([("RCW 1.2.3", "u")], "section string, url string")
    assert {(r.citation, r.url) for r in findings.section_urls(cited, chunks).collect()} == {("RCW 1.2.3(a)", "u"), ("RCW 7.7.7", "")}
    claims = spark.createDataFrame([("no deposit receipt",), ("other",)], "claim string")
    assert [r.item for r in findings.closed_book_claims(claims, {"a": "deposit", "b": "receipt"}).collect()] == ["a", None]


def test_samples_picks_and_carried_fields(spark):
    rows = spark.range(20).withColumn("hit", F.col("id") % 10 == 0)
    sample = studies.review_sample(rows, F.col("hit"), "id", 5, 3)
    assert sample.count() == 5 and sample.filter("flagged").count() == 2
    assert studies.review_sample(rows, F.lit(True), "id", 5, 3).count() == 20
    docs = spark.createDataFrame([("a", "xx", 0), ("b", "xxxx", 1), ("c", "x", 2), ("", "xxxxxxx", 3), ("a", "xxxxx", 4)], "section string, text string, position int")
    assert [r.section for r in studies.picked_sections(docs, ["c", "z"], 2).collect()] == ["c", "a"]
    now = spark.createDataFrame([(1, None, None), (2, None, "y"), (3, None, None)], "file int, p string, q string")
    old = spark.createDataFrame([(1, "old", None), (2, "old", "old")], "file int, p string, q string")
    assert {(r.file, r.p, r.q, r.carried) for r in studies.carried(now, old, "file", ["p", "q"]).collect()} == {(1, "old", None, True), (2, None, "y", False), (3, None, None, False)}


def test_corpus_building(spark):
    entries = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "b", "z"), (3, "c", "w")], "position bigint, section string, content string")
    units = spark.createDataFrame([(0, "u"), (1, "v"), (2, "t")], "unit bigint, content string")
    assert [(r.chunk_id, r.content) for r in corpus.spliced(entries, "b", units, "wa").orderBy("position").collect()] == [("wa-0", "x"), ("wa-1", "u"), ("wa-2", "v"), ("wa-3", "t"), ("wa-4", "w")]
    for bad in ("none", "d"):
        with pytest.raises(ValueError, match="no chunks"):
            corpus.spliced(entries.unionByName(spark.createDataFrame([(4, "d", ""), (6, "d", "")], entries.schema)), bad, units, "wa")
    page = spark.createDataFrame([("59.18.030", "<div>HTML</div><div>PDF</div><h3>RCW 59.18.030</h3><p>Definitions.</p><p>As used &#167; here&#x2014;now &lt;x&gt;</p>")], "section string, fragment string")
    row = corpus.rendered(page).first()
    assert row.name == "rcw-59-18-030.md" and row.content.startswith("# RCW 59.18.030 — Definitions\n\nSource: ") and "As used § here—now <x>" in row.content
    docs = spark.createDataFrame([(1, "x" * 2001), (2, "x" * 2000), (3, "x" * 5000)], "id int, text string")
    chunks = spark.createDataFrame([(1, "x" * 2001), (2, "x" * 2000), (3, "x" * 3001), (3, "x")], "id int, content string")
    assert {(r.id, r.problem) for r in corpus.chunk_problems(docs, chunks, "id").collect()} == {(1, "not split"), (3, "chunk too long")}
    assert corpus.drift_allowed(docs, docs) and not corpus.drift_allowed(docs.limit(2), docs)


def test_texts(spark):
    said = ["It is fully compliant.", "It is not fully compliant; it is void.", "No violations here, but isn't pre-approved and illegal", "Nothing to see"]
    rows = spark.createDataFrame([(s,) for s in said], "a string").select(T.adopted_claim(F.col("a")).alias("c"), T.answer_holds(F.col("a")).alias("h")).collect()
    assert [(r.c, r.h) for r in rows] == [("fully compliant", False), (None, True), ("No violations", False), (None, False)]
    row = spark.range(1).select(
        T.statute_url(F.lit("RCW 59.18.280(1)")).alias("a"), T.statute_url(F.lit("")).alias("b"), T.section_name(F.lit("rcw-59-18-060")).alias("c"), T.leading_number(F.lit(" 12. Rent")).alias("d"),
        T.leading_number(F.lit("12) Rent. x")).alias("e"), T.clause_label(F.lit("Rent"), F.lit(4)).alias("f"), T.clean(F.lit("a​ b\n\tc")).alias("g"), T.without_footer(F.lit("x\n\n**Statutes cited:** y")).alias("h"),
        T.first_mentions(F.lit("RCW 1.2.3 and RCW 4.5.6, RCW 1.2.3(2)")).alias("i"), T.unescaped(F.lit("&#39;&amp;lt;&#x1F600;")).alias("j")).first()
    assert tuple(row)[:5] == ("https://app.leg.wa.gov/RCW/default.aspx?cite=59.18.280", "", "RCW 59.18.060", 12, None)
    assert tuple(row)[5:] == ("Clause 4", "a b c", "x", ["RCW 1.2.3", "RCW 4.5.6"], "'&lt;😀")
    parts = spark.createDataFrame([([("text", "a"), ("image", "b"), ("text", "c")],)], "parts array<struct<type string, text string>>")
    assert parts.select(T.message_text(F.col("parts")).alias("t")).first().t == "ac"


LOG = "client string, clauses int, refused boolean, cache_hit boolean, seconds double, cost_usd double, llm_calls int, embedding_calls int, clauses_total int, gate_flagged boolean, jurisdiction string, verdicts struct<red int, yellow int, green int>, judge string"


def test_log_summaries(spark):
    rows = [("ui", 10, None, None, 1.0, 0.1, 5, 6, None, None, None, (1, 2, 7), "j"), (None, 12, None, False, 3.0, 0.3, 5, 6, 70, True, "or", None, None),
            ("ui", 0, None, None, 9.0, 9.0, 1, 1, None, None, None, None, None), ("ui", 9, True, None, 9.0, 9.0, 1, 1, None, None, None, None, None), ("ui", 11, None, True, 0.0, 0.0, 0, 0, None, None, None, None, None)]
    log = spark.createDataFrame(rows, LOG)
    row = logs.scan_summary(log).first()
    assert (row.scans, row.refusals_excluded, row.cache_hits_excluded, row.mean_cost_usd, row.p50_seconds, row.p95_seconds, row.by_client) == (2, 2, 1, 0.2, 1.0, 3.0, "ui:1,unknown:1")
    assert (row.partial_scans, row.gate_flagged, row.jurisdiction_mismatches) == (1, 1, 1)
    empty = logs.scan_summary(log.limit(0)).first()
    assert (empty.scans, empty.p50_seconds, empty.by_client) == (0, None, "")
    share = logs.verdict_shares(log).first()
    assert (share.verdict_scans, share.verdict_clauses, share.red, share.judges) == (1, 10, 0.1, "j")
    assert logs.verdict_shares(log.limit(0)).count() == 0


def test_ranks_over_wide_ranges(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 1e12, 5.0, 5.0, -1e12)] + [(None, 2.0)], "g string, v double")
    assert {(r.g, r.n, r.p50) for r in at_ranks(rows, "g", "v", {"p50": nearest(0.5)}).collect()} == {("a", 5, 5.0), (None, 1, 2.0)}


def test_index_is_built_once_and_stages_compose(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["rent deposit", "deposit deposit refund", "heat water", "late fee rent", None])], "doc_id bigint, text string")
    engine = Engine(docs)
    assert engine.build_index() is engine.build_index()
    index = engine.build_index()
    assert (index.n, sorted(r.counts[0].tf for r in index.rows.collect() if r.doc_id == 1)) == (4, [2])
    asked = spark.createDataFrame([(1, "deposit"), (2, "heat")], "item_id bigint, text string")
    plain = {(r.item_id, r.doc_id): r.position for r in engine.retrieve(asked).collect()}
    assert plain == {(1, 1): 1, (1, 0): 2, (2, 2): 1}
    rewrites = spark.createDataFrame([(1, "plain", "late"), (2, "statutory", "late"), (1, "statutory", "heat")], "item_id bigint, angle string, text string")
    grades = spark.createDataFrame([(1, True), (2, False)], "item_id bigint, sufficient boolean")
    graded = engine.retrieve(asked, RetrievalConfig(rewritten=True, graded=True), rewrites, grades)
    assert {(r.item_id, r.doc_id) for r in graded.collect()} == {(1, 1), (1, 0), (1, 3), (2, 2), (2, 3)}
    orders = spark.createDataFrame([(1, [2, 9, 1, 2]), (2, [1])], "item_id bigint, ranks array<int>")
    turned = engine.retrieve(asked, RetrievalConfig(reranked=True, final_k=2), orders=orders)
    assert sorted((r.item_id, r.position, r.doc_id) for r in turned.collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 2)]
    assert {r.item_id: r.retrieved for r in engine.ask(asked).collect()} == {1: 2, 2: 1}
    expected = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "item_id bigint, doc_id bigint")
    assert engine.evaluate(engine.retrieve(asked), expected).first().mrr == 0.5
    assert RetrievalConfig(hybrid=True, retrieval_k=6).candidate_k == 20
