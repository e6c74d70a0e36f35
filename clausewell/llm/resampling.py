"""Importance resampling towards a target distribution over hashed word n-grams.

A text's words are joined by single spaces, and that normalised text is scanned once: the running CRC-32 at the end of
each word is kept. The CRC of any run of words then follows from the two running CRCs at its ends: appending n bytes to
a prefix maps the prefix's CRC by a linear map over GF(2), "n zero bytes", and adds the CRC of what was appended, so
mapping the earlier value and adding the later one cancels the prefix. No n-gram is ever spelt out or hashed by itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import Scratch
from clausewell.llm.places import placed
from clausewell.llm.shingles import slices

#: The reflected polynomial of CRC-32, and which bytes make words: digits, letters with A-Z lower-cased,
#: and all bytes of characters from U+0080; any other byte separates.
POLYNOMIAL = 0xEDB88320
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))
#: Lengths up to here have their own map; longer ones go through maps of powers of two.
SHORT = 64
BUCKETS, ORDERS = 10_000, 2


@cache
def byte_table() -> np.ndarray:
    """What each value of a register's low byte adds when one zero byte is appended."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _mapped(maps: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of all values of each of the four bytes, applied to ``values``."""
    out = maps[0][values & 255]
    for k in (1, 2, 3):
        out = out ^ maps[k][(values >> (8 * k)) & 255]
    return out


@cache
def short_maps() -> np.ndarray:
    """The maps of 0 to ``SHORT`` zero bytes, indexed by length, byte and its value."""
    images = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    maps = [images]
    for _ in range(SHORT):
        images = (images >> 8) ^ byte_table()[images & 255]
        maps.append(images)
    return np.stack(maps)


@cache
def power_map(k: int) -> np.ndarray:
    """The map of 2**k zero bytes."""
    if 1 << k <= SHORT:
        return short_maps()[1 << k]
    half = power_map(k - 1)
    return _mapped(half, half)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC carried over as many zero bytes as its length says."""
    maps, near = short_maps(), np.minimum(lengths, SHORT)
    out = maps[near, 0, crcs & 255]
    for k in (1, 2, 3):
        out = out ^ maps[near, k, (crcs >> (8 * k)) & 255]
    far = np.flatnonzero(lengths > SHORT)
    if len(far):
        values, rest = crcs[far], lengths[far]
        for k in range(int(rest.max()).bit_length()):
            values = np.where(rest >> k & 1, _mapped(power_map(k), values), values)
        out[far] = values
    return out


def _after_space(crcs: np.ndarray) -> np.ndarray:
    """CRCs after one more space."""
    register = ~crcs
    return ~((register >> 8) ^ byte_table()[(register ^ 32) & 255])


def run_crcs(texts: list[bytes], orders: int = ORDERS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of every text, and for each order n the CRCs of all runs of n words with their texts' numbers."""
    counts, ends, sizes = [], [], []
    for text in texts:
        words, crc = text.translate(FOLD).split(), 0
        for k, word in enumerate(words):
            crc = zlib.crc32(b" " + word if k else word, crc)
            ends.append(crc)
        counts.append(len(words))
        sizes.extend(map(len, words))
    n_words, end, size = np.array(counts, np.int64), np.array(ends, np.uint32), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(texts)), n_words)
    first = np.repeat(np.cumsum(n_words) - n_words, n_words)
    here = np.arange(len(end))
    begin = np.where(here == first, np.uint32(0), _after_space(end[here - 1])) if len(end) else end
    reach, found = np.cumsum(size + 1), []
    for n in range(1, orders + 1):
        last = here[: max(0, len(end) - n + 1)] + n - 1
        last = last[owner[last] == owner[last - n + 1]]
        start = last - n + 1
        found.append((end[last] ^ shifted(begin[start], reach[last] - reach[start] + size[start]), owner[start]))
    return n_words, found


def featured(texts: DataFrame, key: str, scratch: Scratch, label: str, buckets: int = BUCKETS) -> DataFrame:
    """A written table: ``key``, n_words and ``features``, the buckets of all features of a text, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binary = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            for lo, hi in slices(pc.binary_length(binary).to_numpy(zero_copy_only=False), 1 << 20):
                n_words, runs = run_crcs(binary.slice(lo, hi - lo).to_pylist())
                values, owners = np.concatenate([v for v, _ in runs]), np.concatenate([o for _, o in runs])
                values = (values % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
                values = values[np.argsort(owners, kind="stable")].tobytes()
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=hi - lo))]) * (2 if buckets <= 1 << 16 else 4)
                held = [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(held, pa.binary())], names=[key, "n_words", "features"])

    return scratch.save(texts.select(F.col(key).cast("bigint"), "text").mapInArrow(run, f"{key} bigint, n_words bigint, features binary"), label)


def _decoded(column, buckets: int) -> list[np.ndarray]:
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: ``buckets`` numbers, counted by task and then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in _decoded(batch.column(0), buckets):
                counts += np.bincount(row, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the logarithm of its smoothed share of the target over that of the source, in thousandths, floored."""
    n, total_s, total_t = len(source), int(source.sum()), int(target.sum())
    ratio = ((target + 1).astype(float) * float(total_s + n)) / ((source + 1).astype(float) * float(total_t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of ``<seed>:<doc_id>``; a null id is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, least_words: int = 20, percent: int = 25, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null for rows that are not drawn.

    Counts cover all texts of both tables. Null and empty texts have no words: no features, weight 0, never drawn.
    Rows under one doc_id are rows each, and of equal scores rows without an id come first; an empty table gives no
    rows; without target texts all targets count as none. Other columns are not read.
    """
    source = featured(docs, "doc_id", scratch, "source", buckets)
    wanted = featured(target.select(F.lit(0).alias("item"), "text"), "item", scratch, "target", buckets)
    table = gains(bucket_counts(source, buckets), bucket_counts(wanted, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _decoded(batch.column(2), buckets)
            sizes = np.array([len(r) for r in rows], np.int64)
            sums = np.array([table[r].sum() for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = source.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"))).alias("score"), (F.col("n_words") >= least_words).alias("held"))
    scored = scratch.save(scored, "scored")
    drawn = scored.filter("held").count() * percent // 100
    found = placed(scored, [F.desc("held"), F.desc("score"), F.asc_nulls_first("doc_id")], scratch, "placed")
    rank = F.when(F.col("held") & (F.col("place") < drawn), F.col("place") + 1)
    return found.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"
ORACLE = rf"""with crc_table as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: if(c & 1 = 1, xor(c >> 1, {POLYNOMIAL}), c >> 1))) as t),
w as (select doc_id, row_number() over () as row_no, {_WORDS} as ws from documents),
f as (select row_no, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as feature from w),
g as (select unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as feature from (select {_WORDS} as ws from benchmark)),
c as (select feature, xor(list_reduce([4294967295] || list_transform(range(strlen(feature)), lambda i: ('0x' || hex(encode(feature))[2 * i + 1 : 2 * i + 2])::bigint),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from (select feature from f union select feature from g), crc_table),
a as (select bucket, count(*) as n from f join c using (feature) group by bucket), b as (select bucket, count(*) as n from g join c using (feature) group by bucket),
gain as (select bucket, floor(1000 * ln(((coalesce(b.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from a) + {BUCKETS})::double) / ((coalesce(a.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from b) + {BUCKETS})::double)))::bigint as gain
  from (select distinct bucket from c) left join a using (bucket) left join b using (bucket)),
s as (select row_no, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join c using (feature) join gain using (bucket) group by row_no),
r as (select doc_id, len(ws) >= 20 as held, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5)::double / 4294967296::double)))::bigint as score
  from w left join s using (row_no)),
o as (select *, row_number() over (partition by held order by score desc, doc_id nulls first) as place, count(*) over (partition by held) as size from r)
select doc_id, n_features, weight, score, if(held and place <= 25 * size // 100, place, null) as rank from o"""
