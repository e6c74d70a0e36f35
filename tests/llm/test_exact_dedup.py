"""The Bloom passes: what is shuffled, many slices, and the look-up beyond the broadcast bound."""

import re

from pyspark.sql import functions as F
from twins import SMALL

from clausewell.llm import exact_dedup
from clausewell.llm.common import Scratch


def slow(rows):
    first, size = {}, {}
    plain = {k: re.sub("[\x20\x09-\x0d]+", " ", t or "") for k, t in rows}
    for k in sorted(plain):
        first.setdefault(plain[k], k)
        size[plain[k]] = size.get(plain[k], 0) + 1
    return {k: (first[t], size[t]) for k, t in plain.items()}


def found(docs, spark, **options):
    return {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, Scratch(spark, "t"), **options).collect()}


def test_many_slices_and_no_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, spark) == slow(rows)
    monkeypatch.setattr(exact_dedup, "LEAST_SLICE", 256)
    monkeypatch.setattr(exact_dedup, "MOST_SLICE", 256)
    assert found(docs, spark) == slow(rows)
    assert found(docs, spark, most_words=0) == slow(rows)
    kept = exact_dedup.keep_first(docs, Scratch(spark, "t"), most_words=0)
    assert {r.doc_id for r in kept.collect()} == {first for first, _ in slow(rows).values()}


def test_more_rows_than_one_slice(spark):
    """200,000 rows need 2^22 bits, 64 slices: the pairs are found and nearly all other rows pass straight through."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 999, F.col("id") - 1).otherwise(F.col("id")).cast("string").alias("text"))
    scratch = Scratch(spark, "t")
    digests = scratch.save(docs.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest")), "digests")
    bits = exact_dedup.filter_bits(200_000)
    assert bits == 64 * exact_dedup.slice_cells(bits)
    words = exact_dedup.repeated_words(digests, bits, 200_000, scratch)
    unique, possible = exact_dedup.split_possible(digests, words, bits)
    assert possible.count() < 3000 and unique.count() + possible.count() == 200_000
    result = exact_dedup.exact_groups(docs, Scratch(spark, "t"))
    assert (result.filter("kept").count(), result.filter("group_size = 2").count()) == (199_800, 400)


def test_pass_one_exchanges_packed_lists_alone(spark):
    """The one exchange of pass one lies between the two halves of collect_list, behind the map side."""
    digests = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    plans = []

    class Seen(Scratch):
        def save(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    exact_dedup.repeated_words(digests, 1 << 16, 1000, Seen(spark, "t"))
    plan = plans[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert re.search(r"ObjectHashAggregate\(keys=\[array#\d+, slice#\d+L\], functions=\[collect_list.*\n.*Exchange hashpartitioning.*\n.*ObjectHashAggregate\(keys=\[array#\d+, slice#\d+L\], functions=\[partial_collect_list", plan)


def test_a_hot_text_leaves_its_lists_short(spark):
    """A third of all rows has one text: the sample tells it, two rows stand for it, and the groups are whole."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words").otherwise(F.col("id").cast("string")).alias("text"))
    scratch = Scratch(spark, "t")
    result = exact_dedup.exact_groups(docs, scratch)
    assert spark.read.parquet(scratch.path("hot")).count() == 1
    assert result.filter("group_size = 10000 and keep_id = 0").count() == 10_000 and result.filter("kept").count() == 20_001
