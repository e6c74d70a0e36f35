import json

from pyspark.sql import functions as F

from clausewell.functions import text as T
from clausewell.functions.ranks import at_ranks, nearest
from clausewell.operators import evaluation, retrieval, scan, splitting
from clausewell.sources import tables

def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


RENT, PETS, ENDS = (f"{n} TERM of the lease, " + "with many words " * 6 + "to its end." for n in ("1.", "2)", "ARTICLE IV"))
LINE = "a line of the lease that is one of many"


def test_clauses_spelt_out(spark):
    """Hand-made texts, each with its mode and clauses written down."""
    short, long = "Section 9 Too short.", "s" * 700 + ". " + "t" * 700 + "; end"
    cases = [
        (f"{RENT}\n{PETS}\n{ENDS}", "numbered", [RENT, PETS, ENDS]),
        (f"{'Preamble ' * 10}\n{RENT}\n\n{PETS}\n{short}\n{ENDS}", "numbered", [("Preamble " * 10).strip(), RENT, PETS, ENDS]),
        ("1.1 Rent " + "a " * 40 + "\n 1.2. Fees " + "b " * 40 + "\n 2.10 Pets " + "c " * 40, "numbered", ["1.1 Rent " + ("a " * 40).strip(), "1.2. Fees " + ("b " * 40).strip(), "2.10 Pets " + ("c " * 40).strip()]),
        ("x" * 100 + "\n\n" + "y" * 150 + "\n \n" + "z" * 20, "paragraphs", ["x" * 100 + "\n\n" + "y" * 150, "z" * 20]),
        ("x" * 90 + "\n\n" + "y" * 20 + "\n\n" + "z" * 20, "paragraphs", ["x" * 90 + "\n\n" + "y" * 20 + "\n\n" + "z" * 20]),
        ("\r\n".join([LINE] * 8), "lines", ["\n\n".join([LINE] * 6), "\n\n".join([LINE] * 2)]),
        ("w" * 1500 + ". Next one.", "lines", ["w" * 1500 + ".", "Next one."]), ("w" * 1500, "lines", ["w" * 1200, "w" * 300]),
        (long, "lines", ["s" * 700 + ".", "t" * 700 + "; end"]),
        ("", "lines", []), (" \n ", "lines", []), (None, "lines", [])]
    found = {r.doc_id: r for r in splitting.split_clauses(texts(spark, [t for t, _, _ in cases])).collect()}
    for k, (text, mode, clauses) in enumerate(cases):
        assert (found[k].mode, found[k].clauses) == (mode, clauses), text


def test_clauses_of_documents_keep_their_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in splitting.split_clauses(docs).collect():
        assert all(0 < len(c) <= 1200 and c == c.strip() for c in r.clauses)
        bare = lambda t: "".join(t.split())
        if r.mode != "numbered":
            assert bare("".join(r.clauses)) == bare(whole[r.doc_id])
        assert all(bare(c) in bare(whole[r.doc_id]) for c in r.clauses)


def test_windows(spark):
    rows = spark.createDataFrame([(1, ["a" * 10, "b" * 10, "c" * 30]), (2, [])], "id int, clauses array<string>")
    found = {r.id: r.w for r in rows.select("id", splitting.windows(F.col("clauses"), 22).alias("w")).collect()}
    assert found == {1: ["a" * 10 + "\n\n" + "b" * 10, "c" * 30], 2: [""]}


def test_enumerated_units(spark):
    text = "(1) Intro.\n(2) No lease may provide that the tenant:\n(a) Waives\nrights;\n(b) Pays fees;\n(c) Agrees;\n(d) Leaves.\n(3) Either:\n(a) One;\n(b) Two."
    found = [(r.label, r.item) for r in splitting.enumerated_units(texts(spark, [text])).orderBy("ord").collect()]
    assert found == [("(2)(a)", "Waives rights;"), ("(2)(b)", "Pays fees;"), ("(2)(c)", "Agrees;"), ("(2)(d)", "Leaves.")]


def test_ranks_halve_to_even(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), *(("b", float(x)) for x in (1, 2, 3, 4)), *(("c", 7.0) for _ in range(50))], "g string, v double")
    found = {r.g: (r.n, r.p50) for r in at_ranks(rows, "g", "v", {"p50": nearest(0.5)}).collect()}
    assert found == {"a": (2, 1.0), "b": (4, 3.0), "c": (50, 7.0)}


def test_fusion_ties_and_rerank(spark):
    lists = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 2, "y"), (1, 1, 1, "y"), (1, 1, 2, "x"), (1, 1, 3, "z")], "q int, list_no int, rank int, key string")
    assert [r.key for r in retrieval.fuse(lists, "q", "key", 3).orderBy("rank").collect()] == ["x", "y", "z"]
    hits = spark.createDataFrame([(1, k, f"c{k}") for k in range(1, 5)], "q int, rank int, key string")
    order = spark.createDataFrame([(1, [3, 9, 1, 3, 0])], "q int, ranks array<int>")
    assert [r.key for r in retrieval.reranked(hits, order, "q").orderBy("position").collect()] == ["c3", "c1", "c3"]


def test_bm25_edges(spark):
    docs = texts(spark, ["rent 59.18.280 deposit", "deposit deposit", None, "", "unrelated words"])
    asked = spark.createDataFrame([(1, "deposit"), (2, "59.18.280"), (3, "nothing here"), (4, None)], "item_id bigint, text string")
    found = {(r.item_id, r.doc_id): r.rank for r in retrieval.bm25(asked, docs, "item_id", ["doc_id"], 5).collect()}
    assert found == {(1, 1): 1, (1, 0): 2, (2, 0): 1}
    assert retrieval.bm25(asked, docs.limit(0), "item_id", ["doc_id"], 5).count() == 0


def test_protections_and_scan(spark):
    checks = spark.createDataFrame([(1, 1, 0, "missing"), (1, 1, 1, "present"), (1, 2, 0, "missing"), (1, 2, 1, "not_applicable"), (1, 3, 1, "missing"), (1, 3, 0, "missing")], "doc_id int, index int, window int, status string")
    assert {(r["index"], r.status, r.window) for r in scan.merged_protections(checks).collect()} == {(1, "present", 1), (2, "missing", 0), (3, "missing", 0)}
    found = {r.doc_id: r for r in scan.scan(texts(spark, ["The tenant shall waive all claims.", None, "x" * 384_001, ("y" * 300 + "\n") * 61])).collect()}
    assert [found[k].status for k in range(4)] == ["scanned", "empty", "too_large", "scanned"]
    assert (found[0].red, found[3].partial, found[3].clauses_judged, found[3].clauses_total) == (1, True, 60, 61)


def test_scalars(spark):
    row = spark.range(1).select(
        T.base_section(F.lit("RCW 59.18.280(2)(a)")).alias("a"), T.printed_number(F.lit(" 12) Rent")).alias("b"), T.preview(F.lit("word " * 40)).alias("c"),
        T.mismatch(F.lit("unknown"), F.lit("wa")).alias("d"), T.logged_source(F.lit("/a/My.PDF"), F.lit("ui")).alias("e"), T.chunk_order(F.lit("wa-17")).alias("f"),
        T.counted(F.lit(1), "clause", "clauses").alias("g"), T.page_text(F.lit("<p>a&amp;b</p><p> </p><br/>c")).alias("h")).first()
    assert (row.a, row.b, row.d, row.e, row.f, row.g, row.h) == ("RCW 59.18.280", 12, False, "upload.pdf", 17, "1 clause", "a&b\n\nc")
    assert row.c.endswith("word …") and len(row.c) <= 122


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "q int, rank int")
    row = evaluation.retrieval_metrics(ranks).first()
    assert (row.n, row.mrr, row.hit_1, row.hit_5) == (3, 0.4444, 0.3333, 0.6667)
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert evaluation.kappa(same, "a", "b").first().kappa is None
    assert evaluation.kappa(same.limit(0), "a", "b").first().n == 0


def test_sources(spark, tmp_path):
    (tmp_path / "wa" / "statutes").mkdir(parents=True)
    (tmp_path / "wa" / "statutes" / "one.md").write_text("# RCW 1.2.3 — Title here\n\nSource: http://x/y\n\nBody")
    (tmp_path / "wa" / "statutes" / "two.md").write_text("No heading")
    found = {r.title: (r.section, r.url, r.type) for r in tables.markdown_corpus(spark, str(tmp_path), "wa").collect()}
    assert found == {"Title here": ("RCW 1.2.3", "http://x/y", "statutes"), "two": ("", "", "statutes")}
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in ({"k": 1, "v": "a"}, {"k": 2})))
    old = tables.read_lines(spark, str(tmp_path / "log.jsonl"), "k int, v string")
    assert {(r.k, r.v) for r in tables.upsert(old, spark.createDataFrame([(2, "b")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "b")}
