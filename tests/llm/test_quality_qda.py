"""The discriminant against a numpy version over statistics counted in plain Python."""

import math
import re
import zlib

import numpy as np
from twins import SMALL

from clausewell.llm import quality_qda
from clausewell.llm.common import Scratch
from clausewell.llm.queries import QUERIES


def slow_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    n, chars = len(words), len(re.sub("[\x20\x09-\x0d]", "", text))
    count = lambda keep: sum(keep(c) for c in text)
    ratio = lambda part, whole: math.log((part + 0.5) / (whole + 5))
    return [
        math.log1p(n), math.log((chars + 5) / (n + 1)), ratio(count(lambda c: c in r"#*$%&<>~^{}\="), chars), ratio(count(str.isupper), chars),
        ratio(count(lambda c: c in "0123456789"), chars), ratio(count(lambda c: c in ".,;:?"), n), math.log((len(set(words)) + 1) / (n + 1)),
        math.log((n + 1) / (text.count("\n") + 1)), ratio(text.count("|"), n), ratio(text.count("!"), n), ratio(sum(a == b for a, b in zip(words, words[1:], strict=False)), n)]


def test_scores_against_numpy(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality in (0, 1)]
    rows = {k: np.array(slow_statistics(t)) for k, t in texts.items()}
    learnt = [(rows[k], q) for k, q in labels if k in rows and zlib.crc32(str(k).encode()) % 3 != 1]
    sides = [np.array([x for x, q in learnt if q == c]) for c in (0, 1)]
    spread = [np.cov(x.T, bias=True) for x in sides]
    pooled = sum(len(x) * s for x, s in zip(sides, spread, strict=True)) / len(learnt)
    ridge = 1e-3 + 0.05 * np.trace(pooled) / len(pooled)

    def density(x, c):
        covariance = 0.8 * spread[c] + 0.2 * pooled + ridge * np.eye(len(pooled))
        away = x - sides[c].mean(0)
        return math.log(len(sides[c]) / len(learnt)) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * away @ np.linalg.solve(covariance, away)

    for r in QUERIES["op1_quality_qda"](spark, SMALL).collect():
        gap = max(-700, min(700, density(rows[r.doc_id], 0) - density(rows[r.doc_id], 1)))
        assert math.isclose(r.score, 1 / (1 + math.exp(gap)), rel_tol=1e-6, abs_tol=1e-9)


def test_empty_tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    assert quality_qda.keep_quality(docs.limit(0), labels).count() == 0
    assert quality_qda.keep_quality(docs, labels.limit(0)).count() == docs.count()


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\x0b\t", "a  a\r\na|b!!", "\\ = {x} [y] ~^<>&%$*# 0189.,;:?", "Ä É \U0001d400\U0001d401 ß \u00a0x", "\n\n||!\n", "A" * 5000 + " 7" * 5000]
    rows = quality_qda.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).collect()
    for r in rows:
        assert np.allclose(r[1:], slow_statistics(texts[r.doc_id]), rtol=1e-12)


def test_few_files(spark):
    """A process is started for every file made: none holds statistics, and a result of few rows has few tasks."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    scratch = Scratch(spark, "few")
    found = quality_qda.quality_scores(docs.repartition(64), labels, scratch)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() == docs.count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
