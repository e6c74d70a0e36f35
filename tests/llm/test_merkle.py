"""The manifest against a plain tree in memory, small blocks included, and the storage order's arithmetic."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from twins import check

from clausewell.llm import merkle
from clausewell.llm.common import Scratch
from clausewell.llm.queries import ORACLES, QUERIES


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    k, source, lang, n, text = row
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (k, source, lang, n, text)))


def path(level, i):
    """The root over ``level`` and the siblings of its node i, as (left, right)."""
    found = []
    while len(level) > 1:
        run = i - i % 8
        found.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        level, i = [digest("".join(level[a : a + 8])) for a in range(0, len(level), 8)], i // 8
    return level[0], found


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    each = [(r, leaf_of(r), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0) for r in rows]
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tampered = lambda r: leaf_of((*r[:4], low(r[4])))
    trees = {}
    for x in each:
        trees.setdefault(x[0][2], []).append(x)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for n in names:
        trees[n].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1], tampered(x[0]) if x[2] else ""))
    roots = [path([x[1] for x in trees[n]], 0)[0] for n in names]
    out = Counter()
    for at, n in enumerate(names):
        leaves = [x[1] for x in trees[n]]
        root, upper = path(roots, at)
        for i, (r, leaf, hit) in enumerate(trees[n]):
            way = path(leaves, i)[1] + upper
            end = tampered(r) if hit else leaf
            for a, b in way:
                end = digest(a + end + b)
            out[r[0], leaf, roots[at], root, digest("".join(a + b for a, b in way)), end, end == root] += 1
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "key": F.lit("k"), "total": F.lit(None).cast("int"), "_cw_at": F.lit(0)})
    return Counter(map(tuple, merkle.manifest(docs, Scratch(spark, "t"), **options).collect()))


def test_against_sql(spark):
    check(spark, QUERIES["op12_veb_merkle_manifest"], ORACLES["op12_veb_merkle_manifest"])


def test_odd_rows(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"Text {k}") for k in range(70)] + [(k, None, "xé", None, "lower") for k in range(9)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "", "", 0, "T" * 300_000), (1, "a", "only", 1, "É Q"), (None, "x", "en", 2, "Q"), (10**15, "x", "en", -2, "Q")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])
    assert found(spark, []) == Counter()


@pytest.mark.parametrize("n", [8, 9, 150, 513])
def test_blocks_recurse_over_their_roots(spark, n):
    """With blocks of one level (8 leaves) these trees take up to four rounds, and many languages make a second tree of rounds."""
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(n)] + [(k, "s", f"l{k % 20}", k, "B") for k in range(40 if n == 150 else 0)]
    assert found(spark, rows, most=1) == plain(rows)


def test_addresses_are_recursive_halves():
    for levels in range(1, 6):
        every = np.concatenate([merkle.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(every.tolist()) == list(range((8**levels - 1) // 7))
    # four levels: a top of two, then each subtree of two levels in one piece
    for j in range(64):
        children = merkle.address(4, 3, np.arange(8 * j, 8 * j + 8))
        assert merkle.address(4, 2, np.array([j]))[0] + 1 == children[0] and (np.diff(children) == 1).all()
    assert merkle.address(4, 1, np.arange(8)).tolist() == list(range(1, 9))


def test_siblings_fold_to_the_root():
    leaves = [digest(str(k)) for k in range(300)]
    nodes, root = merkle.build(leaves, 4)
    assert root == digest(path(leaves, 0)[0])  # 300 leaves need three levels; a block of a larger tree has all four
    for leaf, way in zip(leaves, merkle.siblings(nodes, 300, 4), strict=True):
        assert merkle.folded(leaf, way) == root
