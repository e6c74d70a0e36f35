"""A Merkle manifest of a table: trees of eight children per language, stored in blocks in the van Emde Boas order.

A tree is cut into aligned blocks of four levels: 4096 neighbouring nodes and all that stands above them up to one
block root. A block is one row, its nodes one binary value: a tree of h levels is split at half its height, the top
half is stored first and then each bottom subtree, and both are stored in the same way, so that a node's address
follows from its depth and number alone. The block roots are the leaves of the next round, until one node is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import Scratch
from clausewell.llm.places import placed

ARITY, HEIGHT = 8, 4
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = "key string, block bigint, total bigint, height int, nodes binary, root string"


def _size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of nodes, told by their depth from the root and their number from the left, in a tree of ``levels``."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(top, depth, number)
    below = ARITY ** (depth - top)
    return _size(top) + number // below * _size(levels - top) + address(levels - top, depth - top, number % below)


@cache
def _addresses(levels: int) -> list[np.ndarray]:
    """The places of all nodes of each depth."""
    return [address(levels, depth, np.arange(ARITY**depth)) for depth in range(levels)]


def height_of(total: int, most: int = HEIGHT) -> int:
    """How many times runs of eight are hashed in a block of a tree with ``total`` nodes in this round."""
    height = 0
    while height < most and ARITY**height < total:
        height += 1
    return height


def widths(leaves: int, height: int) -> list[int]:
    """How many nodes a block has at each depth, root first."""
    found = [leaves]
    for _ in range(height):
        found.append(-(-found[-1] // ARITY))
    return found[::-1]


def build(leaves: list[str], height: int) -> tuple[bytes, str]:
    """The nodes of a block above its leaves' hexadecimal digests, and its root."""
    places, now = _addresses(height + 1), leaves
    nodes = np.zeros((_size(height + 1), 32), np.uint8)
    for depth in range(height, -1, -1):
        nodes[places[depth][: len(now)]] = np.frombuffer(bytes.fromhex("".join(now)), np.uint8).reshape(-1, 32)
        if depth:
            now = [hashlib.sha256("".join(now[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(now), ARITY)]
    return nodes.tobytes(), now[0]


def siblings(nodes: bytes, leaves: int, height: int) -> Iterator[list[tuple[str, str]]]:
    """For every leaf its siblings' digests up to the block's root: per level what stands left of the path, and right."""
    table, places, counts = np.frombuffer(nodes, np.uint8).reshape(-1, 32), _addresses(height + 1), widths(leaves, height)
    level = {d: table[places[d][: counts[d]]].tobytes().hex() for d in range(1, height + 1)}
    for leaf in range(leaves):
        path, number = [], leaf
        for depth in range(height, 0, -1):
            run = number - number % ARITY
            path.append((level[depth][64 * run : 64 * number], level[depth][64 * (number + 1) : 64 * (run + ARITY)]))
            number //= ARITY
        yield path


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def leaf_hash(text: Column) -> Column:
    """SHA-256 of a row's fields, each by its length in bytes, with ``text`` in place of its text."""
    each = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _round(leaves: DataFrame, scratch: Scratch, label: str, most: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Written blocks of ``most`` levels above rows (key, place, total, leaf); columns ``carried`` become lists in the order of the leaves."""
    kinds = dict(leaves.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total = table["total"][0].as_py()
        height = height_of(total, most)
        nodes, root = build(table["leaf"].to_pylist(), height)
        out = {"key": table["key"][:1], "block": table["block"][:1], "total": [total], "height": pa.array([height], pa.int32()), "nodes": [nodes], "root": [root]}
        return pa.table(out | {c: pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("leaf", *carried)})

    schema = BLOCK + "".join(f", {c} array<{kinds[c]}>" for c in ("leaf", *carried))
    rows = leaves.select("key", F.floor(F.col("place") / ARITY**most).alias("block"), "place", "total", "leaf", *carried)
    return scratch.save(rows.groupBy("key", "block").applyInArrow(run, schema), label)


def grown(leaves: DataFrame, scratch: Scratch, label: str, most: int, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The blocks of all rounds over rows (key, place, total, leaf), lowest first."""
    rounds = [_round(leaves, scratch, f"{label}-0", most, carried)]
    while not (more := rounds[-1].filter(F.col("total") > ARITY**most)).isEmpty():
        next_total = F.ceil(F.col("total") / ARITY**most)
        upper = more.select("key", F.col("block").alias("place"), next_total.alias("total"), F.col("root").alias("leaf"))
        rounds.append(_round(upper, scratch, f"{label}-{len(rounds)}", most))
    return rounds


def top_rows(rounds: list[DataFrame], most: int) -> DataFrame:
    """(key, root): the last node of every tree."""
    found = [r.filter(F.col("total") <= ARITY**most).select("key", "root") for r in rounds]
    for one in found[1:]:
        found[0] = found[0].unionByName(one)
    return found[0]


ABOVE = "array<struct<l: string, r: string>>"


def _paths(blocks: DataFrame, most: int) -> DataFrame:
    """(key, block, above) of the blocks below: the siblings on the way from each block root up, those of ``blocks`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, height, nodes, leaves, above in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                path = [[{"l": a, "r": b} for a, b in own] + above for own in siblings(nodes, leaves, height)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * leaves, pa.string()), pa.array(np.arange(leaves) + block * ARITY**most), pa.array(path, pa.list_(pa.struct({"l": pa.string(), "r": pa.string()})))],
                    names=["key", "block", "above"])

    return blocks.select("key", "block", "height", "nodes", F.size("leaf"), "above").mapInArrow(run, f"key string, block bigint, above {ABOVE}")


def with_above(rounds: list[DataFrame], tops: DataFrame, scratch: Scratch, label: str, most: int) -> DataFrame:
    """The lowest round's blocks with the siblings above each: ``tops`` (key, above) stand above the last node of a tree."""
    below: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = rounds[k].filter(F.col("total") <= ARITY**most).select("key", "block").join(tops, "key")
        known = ends if below is None else ends.unionByName(below)
        blocks = rounds[k].join(known, ["key", "block"])
        if k == 0:
            return blocks
        below = scratch.save(_paths(blocks, most), f"{label}-above-{k}")
    raise ValueError("no rounds")


def manifest(docs: DataFrame, scratch: Scratch, most: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    Rows are the leaves of the tree of their language, in the order of doc_id (null first; repeated ids by their leaf).
    A null language is a tree of its own, the first one. Null and empty fields hash apart. Rows without an id are never
    tampered with. An empty table gives no rows; other columns are not read. ``most``: levels of a block.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_hash(lower_ascii(F.col("text"))))
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = scratch.save(docs.select("doc_id", key.alias("key"), leaf_hash(F.col("text")).alias("leaf"), changed.alias("changed")), "leaves")
    rows = placed(rows, [F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("changed")], scratch, "placed", "key")
    trees = grown(rows, scratch, "tree", most, ("doc_id", "changed"))
    # the trees' last nodes, in the order of their languages, are the leaves of one tree more
    subroots = scratch.save(top_rows(trees, most), "subroots")
    named = placed(subroots.withColumnRenamed("root", "leaf"), [F.asc("key")], scratch, "placed-subroots")
    crown = grown(named.withColumn("name", F.col("key")).withColumn("key", F.lit("")), scratch, "crown", most, ("name",))
    root = top_rows(crown, most).first()
    none = docs.sparkSession.createDataFrame([("", [])], f"key string, above {ABOVE}")
    crowned = scratch.save(with_above(crown, none, scratch, "crown", most), "crowned")
    places = named.select("key", F.col("place").alias("block")).withColumnRenamed("key", "name")
    tops = places.join(_paths(crowned, most).drop("key"), "block").select(F.col("name").alias("key"), "above").join(subroots.withColumnRenamed("root", "subroot"), "key")
    lowest = with_above(trees, tops.select("key", "above"), scratch, "tree", most).join(tops.select("key", "subroot"), "key")
    last = root["root"] if root else ""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for height, nodes, above, subroot, ids, leaves, tampered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                upper = [(x["l"], x["r"]) for x in above]
                rest = "".join(a + b for a, b in upper)
                proofs, ends = [], []
                for path, leaf, other in zip(siblings(nodes, len(leaves), height), leaves, tampered, strict=True):
                    proofs.append(hashlib.sha256(("".join(a + b for a, b in path) + rest).encode()).hexdigest())
                    ends.append(folded(other or leaf, path + upper))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(leaves), pa.array([subroot] * len(ids)), pa.array([last] * len(ids)), pa.array(proofs), pa.array(ends), pa.array([e == last for e in ends])],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return lowest.select("height", "nodes", "above", "subroot", "doc_id", "leaf", "changed").mapInArrow(prove, RESULT)


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


_H = "sha256(string_agg(h, '' order by place))"
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_TAMPERED = _LEAF.replace(_FIELD.format("text"), _FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
#: Every tree level by level; a row's path through both trees; and one fold along it. The CRC runs over a few digits only.
ORACLE = rf"""with recursive crc_table as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: if(c & 1 = 1, xor(c >> 1, {0xEDB88320}), c >> 1))) as t),
l as (select doc_id, coalesce('=' || lang, '') as tree, sha256({_LEAF}) as leaf, sha256({_TAMPERED}) as lowered,
    xor(list_reduce([4294967295] || list_transform(range(strlen(doc_id::varchar)), lambda i: ('0x' || hex(encode(doc_id::varchar))[2 * i + 1 : 2 * i + 2])::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 as hit from documents, crc_table),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, if(hit, lowered, null) nulls first) - 1 as place from l),
t as (select tree, 0 as level, place, leaf as h, count(*) over (partition by tree) as size from p
    union all select tree, level + 1, place // {ARITY} as place, {_H}, any_value(size + {ARITY - 1}) // {ARITY} from t where size > 1 group by tree, level, place // {ARITY}),
s as (select tree, h as subroot, row_number() over (order by tree) - 1 as place from t where size = 1),
c as (select '' as tree, 0 as level, place, subroot as h, count(*) over () as size from s
    union all select '', level + 1, place // {ARITY} as place, {_H}, any_value(size + {ARITY - 1}) // {ARITY} from c where size > 1 group by level, place // {ARITY}),
n as (select 0 as part, * from t where size > 1 union all select 1, * from c where size > 1),
r as (select part, tree, level, place, (select string_agg(m.h, '' order by m.place) from n m where m.part = n.part and m.tree = n.tree and m.level = n.level and m.place // {ARITY} = n.place // {ARITY} and m.place < n.place) as a,
    (select string_agg(m.h, '' order by m.place) from n m where m.part = n.part and m.tree = n.tree and m.level = n.level and m.place // {ARITY} = n.place // {ARITY} and m.place > n.place) as b from n),
q as (select part, tree, level, place, coalesce(a, '') as a, coalesce(b, '') as b from r),
o as (select p.*, s.subroot, s.place as crown, row_number() over () as row_no from p join s using (tree)),
w as (select row_no, level + 0 as step, a, b from o join q on part = 0 and q.tree = o.tree and q.place = o.place >> (3 * level)
    union all select row_no, level + 1000, a, b from o join q on part = 1 and q.place = o.crown >> (3 * level)),
g as (select row_no, list(a order by step) as a, list(b order by step) as b, sha256(string_agg(a || b, '' order by step)) as proof from w group by row_no),
f as (select doc_id, leaf, subroot, (select h from c where size = 1) as root, coalesce(proof, sha256('')) as proof_sha256,
    list_reduce([if(hit, lowered, leaf)] || list_transform(range(len(coalesce(g.a, []))), lambda i: i::varchar), lambda h, i: sha256(g.a[i::bigint + 1] || h || g.b[i::bigint + 1])) as folded_root from o left join g using (row_no))
select *, folded_root = root as verified from f"""
