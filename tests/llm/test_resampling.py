"""Resampling against a plain version: CRCs of spelt-out n-grams, counters, and one sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from twins import SMALL, check

from clausewell.llm import resampling
from clausewell.llm.common import Scratch
from clausewell.llm.queries import ORACLES, QUERIES


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def buckets(text, n):
    w = words(text)
    return [zlib.crc32(x.encode()) % n for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(docs, target, n=10_000, least=20, percent=25):
    rows = [(k, len(words(t)), buckets(t, n)) for k, t in docs]
    s, t = Counter(b for _, _, bs in rows for b in bs), Counter(b for x in target for b in buckets(x, n))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in range(n)}
    out = []
    for k, size, bs in rows:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), size >= least))
    held = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(held[: percent * len(held) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def found(spark, docs, target, **options):
    return Counter(map(tuple, resampling.resample(docs, target, Scratch(spark, "t"), **options).collect()))


def test_against_sql(spark):
    check(spark, QUERIES["op13_prefix_crc_resampling"], ORACLES["op13_prefix_crc_resampling"])


def test_odd_rows(spark):
    rows = [(k, " ".join(f"W{k % 7}x{j % (k % 5 + 2)}é" for j in range(k))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "!? \n"), (None, "a b " * 30), (None, "a b " * 30), (7, "A-b_c"), (7, "one"), (103, "z" * 3000 + " " + "y" * 70), (104, "é" * 500_000 + " q" * 200_000)]
    target = ["w1x1é W1X0é", None, "", "zz top"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"rank": F.lit("x"), "_cw_part": F.lit(1), "score": F.lit(None).cast("int")})
    asked = spark.createDataFrame([(1, t) for t in target], "item_id int, text string")
    assert found(spark, docs, asked) == plain(rows, target)
    assert found(spark, docs.repartition(5), asked, least_words=2, percent=60, buckets=70_000) == plain(rows, target, 70_000, 2, 60)
    assert found(spark, docs.limit(0), asked) == Counter()
    assert found(spark, docs, asked.limit(0)) == plain(rows, [])


def test_crcs_of_runs_follow_from_prefixes():
    texts = [b"a", b"", b"x" * 64 + b" " + b"y" * 65 + b" " + b"z" * 5000 + b" tail", "Ünï Cödé 9".encode(), b"..q..R--"]
    counts, runs = resampling.run_crcs(texts, 4)
    split = [t.translate(resampling.FOLD).split() for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    for n, (values, owners) in enumerate(runs, 1):
        want = [(zlib.crc32(b" ".join(w[i : i + n])), k) for k, w in enumerate(split) for i in range(len(w) - n + 1)]
        assert list(zip(values.tolist(), owners.tolist(), strict=True)) == want
    crcs = np.array([zlib.crc32(b"abc")] * 3, np.uint32)
    assert resampling.shifted(crcs, np.array([0, 3, 100_000])).tolist()[0] == zlib.crc32(b"abc")
    assert resampling.shifted(crcs, np.array([0, 3, 100_000]))[1] ^ zlib.crc32(b"def") == zlib.crc32(b"abcdef")


def test_ranks_need_no_single_task(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = resampling.resample(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"), Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
