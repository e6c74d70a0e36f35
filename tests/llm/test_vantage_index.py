"""Vantage-point trees against all pairs: exact with factor one, recall and work with more."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from twins import SMALL, check

from clausewell.llm import vantage_index
from clausewell.llm.common import Scratch
from clausewell.llm.queries import ORACLES, QUERIES
from clausewell.llm.vantage_tree import Search, Tree, cosines, grow


def plain(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for i, v in good:
        if i % every == 0:
            best = sorted({(-cosines(v[None] / 2, w[None] / 2)[0], j) for j, w in good if j != i and len(w) == len(v)})
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best[:k], 1)}
    return out


def found(spark, rows, kind="float", **options):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({"digest": F.lit("x"), "rank": F.lit(1), "_cw_n": F.lit(0)})
    hits = vantage_index.nearest(table, F.col("vec_id") % 3 == 0, Scratch(spark, "t"), **options).collect()
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in hits}


def clustered(n, dim=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.08 * rng.normal(size=(n, dim))).astype(np.float32)


def test_against_sql(spark):
    check(spark, QUERIES["op11_vantage_point_search"], ORACLES["op11_vantage_point_search"])


def test_exact_over_many_shards(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(700))]
    assert found(spark, rows, shard=100, block=7) == plain(rows, 5, 3)


def test_odd_vectors(spark):
    rows = [(k, [1.0, 2.0, -3.0]) for k in range(40)] + [(100 + k, [2.0, 4.0, -6.0]) for k in range(5)] + [(200, [0.0, 0.0, 0.0]), (201, None), (202, [1.0, None, 1.0]), (203, []), (204, [float("nan"), 1.0, 1.0])]
    rows += [(206, [float("inf"), 1.0, 0.0]), (207, [1.0, 0.0]), (210, [-1.0, -0.0]), (213, [1.0]), (300, [-1.0, -2.0, 3.0]), (303, [1e-30, 0.0, 0.0]), (None, [1.0, 2.0, 3.0])]
    assert found(spark, rows) == plain(rows, 5, 3)
    assert found(spark, rows, shard=4, block=2, k=2) == plain(rows, 2, 3)
    assert found(spark, []) == set()
    assert found(spark, rows[-8:-7]) == set()
    huge = [(3, [1e200, 1e200]), (4, [-1e200, 3e200]), (5, [1e-200, 1e-201])]
    assert {h[:3]: h[3] for h in found(spark, huge, "double")} == pytest.approx({(3, 1, 5): 0.77395730, (3, 2, 4): 0.4472136}, rel=1e-6)


def test_repeated_ids(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0]), (4, [0.0, 1.0])]
    assert {h[:3] for h in found(spark, rows)} == {(3, 1, 4), (3, 2, 4)}


def test_hot_vectors_are_kept_short(spark):
    """A third of the rows is one vector: six rows stand for it in the trees, and every query still gets its neighbours."""
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else [float(k % 97), float(k % 89), 1.0]) for k in range(3000)]
    scratch = Scratch(spark, "t")
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    hits = vantage_index.nearest(table, F.col("vec_id") % 3 == 0, scratch).collect()
    assert len(hits) == 5000 and {r.vec_id for r in hits if r.query_id == 2997} == {0, 3, 6, 9, 12}
    assert {r.vec_id for r in hits if r.query_id == 3} == {0, 6, 9, 12, 15}
    assert spark.read.parquet(scratch.path("kept")).filter("id % 3 = 0").count() == 6


def test_factor_trades_recall_for_work():
    vectors = clustered(4096, 8, 40).astype(float)
    order, bounds = grow(vectors)
    tree = Tree(order, vectors[order], bounds)
    truth = Search(vectors[::50], 6)
    truth.scores, truth.ids = (lambda s, best: (np.take_along_axis(s, best, 1), best))(
        s := (u := vectors / np.linalg.norm(vectors, axis=1)[:, None])[::50] @ u.T, np.argsort(-s, axis=1, kind="stable")[:, :6])
    compared, recall = [], []
    for factor in (1.0, 2.0, 4.0):
        search = Search(vectors[::50], 6, factor=factor)
        search.visit(tree)
        compared.append(search.compared)
        recall.append(np.mean([len(set(a) & set(b)) / 6 for a, b in zip(search.ids, truth.ids, strict=True)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9 and compared[0] < 82 * 4096 / 2 and compared[0] > compared[1] > compared[2]


def test_recall_on_the_table(spark):
    """A factor of 1.5 keeps a recall of 0.9 and more against all pairs."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    hits = vantage_index.nearest(table, F.col("vec_id") % 50 == 0, Scratch(spark, "t"), factor=1.5, shard=64).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    want = set()
    for q in (i for i in rows if i % 50 == 0):
        want |= {(q, j) for _, j in sorted((-(rows[q] @ v) / np.linalg.norm(rows[q]) / np.linalg.norm(v), j) for j, v in rows.items() if j != q)[:5]}
    assert len({(r.query_id, r.vec_id) for r in hits} & want) >= 0.9 * len(want)
