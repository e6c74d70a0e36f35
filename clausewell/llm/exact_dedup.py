"""Exact deduplication by two Bloom passes, with DataFrame functions only.

Pass one maps every text's SHA-256 to one cell in each of two bit arrays and keeps the cells that more than one row
hit. No row is shuffled for it: a task packs the cells of its rows into one list per slice of an array, and the tasks'
lists, four bytes a cell, meet by slice. Digests that a sample holds three times are known to repeat; two rows stand for
all of theirs, so that no list grows with one hot text. Pass two looks every row up: a row with an unshared cell is certainly unique
and passes straight through; only the possibly repeated rows are shuffled, by their digest, and grouped exactly.

The bit arrays have 16 bits or more for each row at every size. The shared cells' words are
broadcast while their counted rows are at most ``most_words``, a proven bound of about 40 bytes each; beyond it the
narrow (doc_id, digest) rows meet them in a shuffled join, with the same result.

Defined cases: null text is the empty text, and all empty texts are equal; of rows with equal text the smallest
doc_id stays (null ids only where no other is there, and then all of them); rows repeated under one doc_id share the
decision; other columns pass through and may have any name that does not start with ``_cw_``; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import BLANKS, Scratch, attach_groups, own

ARRAYS = 2
#: Bounds of the cells of one slice. One task holds a slice's list: at 16 bits a row, 4 million hit cells at most on average.
LEAST_SLICE, MOST_SLICE = 1 << 16, 1 << 26
#: Rows of the sample that tells hot digests; it steers the size of lists and changes no result.
SAMPLED = 100_000
MOST_WORDS = 1 << 21


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with every run of blanks as one space."""
    return F.sha2(F.regexp_replace(own(text), BLANKS, " "), 256)


def filter_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < 16 * rows:
        bits *= 2
    return bits


def _cell(digest: str, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(digest), F.lit(k)), F.lit(bits))


def slice_cells(bits: int) -> int:
    return min(max(bits // 256, LEAST_SLICE), MOST_SLICE)


def repeated_words(digests: DataFrame, bits: int, total: int, scratch: Scratch) -> DataFrame:
    """(array, word, bits): the 64-bit words of both arrays that hold a cell hit by two rows or more.

    ``collect_list`` is merged on the map side, so an exchange carries one packed list per task and slice; what
    follows stays in the slice's task.
    """
    size = slice_cells(bits)
    hot = digests.sample(min(0.1, SAMPLED / max(total, 1)), seed=17).groupBy("digest").count().filter("count > 2").select("digest")
    hot = scratch.save(hot, "hot")
    counted = digests.select("digest").join(F.broadcast(hot), "digest", "left_anti").union(hot).union(hot)
    cells = counted.select(F.explode(F.array(*(
        F.struct(F.lit(k).alias("array"), _cell("digest", k, bits).alias("cell")) for k in range(ARRAYS)))).alias("c")).select("c.*")
    sliced = cells.select("array", F.expr(f"cell div {size}").alias("slice"), F.expr(f"cast(cell % {size} as int)").alias("place"))
    lists = sliced.groupBy("array", "slice").agg(F.collect_list("place").alias("places"))
    twice = lists.select("array", "slice", F.explode("places").alias("place")).groupBy("array", "slice", "place").count().filter("count > 1")
    words = twice.groupBy("array", "slice", F.expr("place div 64").alias("part")).agg(
        F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    return scratch.save(words.select("array", F.expr(f"slice * {size // 64} + part").alias("word"), "bits"), "words")


def split_possible(rows: DataFrame, words: DataFrame, bits: int, digest: str = "digest", most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(certainly unique rows, possibly repeated rows); with few words both are scans with broadcast look-ups and no shuffle."""
    small = words.count() <= most_words
    marked = rows
    for k in range(ARRAYS):
        array = words.filter(F.col("array") == k).select(F.col("word").alias(f"_cw_word{k}"), F.col("bits").alias(f"_cw_bits{k}"))
        marked = marked.withColumn(f"_cw_cell{k}", _cell(digest, k, bits))
        array = F.broadcast(array) if small else array.hint("shuffle_merge")
        marked = marked.join(array, F.expr(f"_cw_cell{k} div 64") == F.col(f"_cw_word{k}"), "left")
    hit = F.lit(True)
    for k in range(ARRAYS):
        hit = hit & F.expr(f"coalesce(getbit(_cw_bits{k}, cast(_cw_cell{k} % 64 as int)), 0) = 1")
    names = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(~hit).select(*names), marked.filter(hit).select(*names)


def _passes(digests: DataFrame, scratch: Scratch, bits: int | None) -> tuple[int, int, DataFrame]:
    total = digests.count()
    bits = bits or filter_bits(total)
    return total, bits, repeated_words(digests, bits, total, scratch)


def exact_groups(docs: DataFrame, scratch: Scratch, most_bits: int | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``. ``most_bits`` sets the arrays' size by hand."""
    digests = scratch.save(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    total, bits, words = _passes(digests, scratch, most_bits)
    unique, possible = split_possible(digests, words, bits, most_words=most_words)
    groups = scratch.save(possible.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    grouped = attach_groups(possible, groups, ["digest"], "group_size", total)
    alone = unique.select("digest", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    return alone.unionByName(grouped.select("digest", "doc_id", "keep_id", "group_size")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, scratch: Scratch, most_bits: int | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged. Only texts of possibly repeated rows are shuffled, while the words fit ``most_words``."""
    digests = scratch.save(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    _, bits, words = _passes(digests, scratch, most_bits)
    keepers = split_possible(digests, words, bits, most_words=most_words)[1].groupBy("digest").agg(F.min("doc_id").alias("_cw_keep"))
    keepers = scratch.save(keepers, "keepers").withColumnRenamed("digest", "_cw_kept_digest")
    unique, possible = split_possible(docs.withColumn("_cw_digest", text_digest(F.col("text"))), words, bits, "_cw_digest", most_words)
    first = possible.join(keepers, F.col("doc_id").eqNullSafe(F.col("_cw_keep")) & (F.col("_cw_digest") == F.col("_cw_kept_digest")), "left_semi")
    return unique.unionByName(first).drop("_cw_digest")


ORACLE = """
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
"""
