"""The secret scan's candidates and features against plain Python, and its forests on candidates they have not seen."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from twins import SMALL

from clausewell.llm import secret_forest as scan
from clausewell.llm.common import Scratch

ODD = ["", None, "token=", "my token: 'a b c' and x", "é password=\"x1\" é", "A" * 16 + " " + "b1" * 20 + ".png", "http://h/" + "q1" * 9 + " sha: " + "0f" * 20, "😀 secret => " + "k" * 90_000]


def plain(pattern):
    return re.compile(pattern.replace("(?i)", ""), re.ASCII | re.IGNORECASE)


def slow_candidates(text):
    text, out = text or "", []
    if not plain(f"{scan.NAMED}|{scan.RUN}").search(text):
        return out
    places = list(plain(scan.FOUND if plain(scan.NAMED).search(text) else scan.RUN).finditer(text))
    ends = [0, *(m.end() for m in places)]
    nexts = [*(m.start() for m in places[1:]), len(text)]
    for m, last, upto in zip(places, ends, nexts, strict=False):
        head = plain(scan.HEAD).match(m[0])
        head = head[0] if head and len(head[0]) < len(m[0]) else ""
        out.append((m.start() + len(head), m[0][len(head) :], (text[last : m.start()][-48:] + head)[-48:], text[m.end() : upto][:48]))
    return out


def kinds(text):
    return "".join("0" if c in "0123456789" else c if "a" <= c <= "z" else "*" if c.isalpha() else "-" for c in text.lower())


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return given.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string"))


def test_candidates_and_features_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    table = scan.with_features(scan.candidates(docs), scan.corpus_model(docs, Scratch(spark, "t"))).collect()
    assert sorted((r.doc_id, r.start, r.candidate, r.before, r.after) for r in table) == sorted((k, *c) for k, t in texts.items() for c in slow_candidates(t))
    tokens = Counter(w for t in texts.values() for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if 1 < len(w) <= 64)
    steps = Counter()
    for w, n in tokens.items():
        for pair in zip(kinds(w), kinds(w)[1:], strict=False):
            steps[pair] += n
    totals = {a: sum(steps[a, b] + 1 for b in scan.CLASSES) for a in scan.CLASSES}
    words = Counter()
    for w, n in tokens.items():
        if re.fullmatch(r"[^\W\d_]{3,}", bare := re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w)):
            words[bare] += n
    known = {w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: scan.MOST_WORDS] if n > 1}
    for r in table:
        c = r.candidate
        pairs = list(zip(kinds(c), kinds(c)[1:], strict=False))
        assert math.isclose(r.transitions, sum(round(math.log((steps[p] + 1) / totals[p[0]]), 6) for p in pairs) / max(len(pairs), 1), abs_tol=1e-6)
        parts = re.findall("[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]{2,}|[A-ZÀ-ÖØ-Þ]{3,}", c)
        assert math.isclose(r.dictionary, sum(len(w) for w in parts if w.lower() in known) / len(c), abs_tol=1e-9)
        assert math.isclose(r.digit_share, sum(x in "0123456789" for x in c) / len(c)) and math.isclose(r.length, math.log(len(c)))
        assert r.slashes == c.count("/") / len(c) and r.distinct == len(set(c)) / len(c)


def test_no_forest_sees_its_labels_evidence():
    assert not set(scan.VALUE_FEATURES) & {"assigned", "quoted", "key_name_near", "in_link", "other_name_near"}
    assert not set(scan.NEAR_FEATURES) & {"digit_only", "kind_changes", "digit_share", "slashes", "dictionary", "provider_format"}


def test_forests_on_unseen_candidates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = Scratch(spark, "t").save(scan.with_features(scan.candidates(docs), scan.corpus_model(docs, Scratch(spark, "t"))), "f")
    found = {r.view: r for r in scan.held_out_quality(table).collect()}
    assert all(found[v].n > 20 and found[v].precision >= 0.9 and found[v].recall >= 0.9 for v in ("value", "near"))


def test_labelled_findings_can_be_given(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scratch = Scratch(spark, "t")
    table = scratch.save(scan.with_features(scan.candidates(docs), scan.corpus_model(docs, scratch)), "f")
    long = table.withColumn("label", (F.length("candidate") == 16).cast("double"))
    found = scan.scored(table, long).collect()
    assert found and all((r.score >= 0.5) == (len(r.candidate) == 16) for r in found)


def test_texts_of_very_many_runs(spark):
    text = " ".join(f"abcdefghij{k:08d}xyz" for k in range(40_000))
    found = scan.candidates(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).agg(F.count("*").alias("n"), F.sum("start").alias("s")).first()
    assert (found.n, found.s) == (40_000, sum(22 * k for k in range(40_000)))
