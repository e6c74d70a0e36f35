"""Nearest neighbours by cosine over vantage-point trees, one tree per shard of a table.

Rows are dealt to cells by the nearest of some pivots, and cells to shards of a bounded size, each with a tree. A query
is first searched in one shard of its own cell; the distance of the last of its neighbours there then bounds which
other shards can hold nearer ones, by the triangle inequality over their pivots, and prunes their trees. All bounds are
multiplied by ``factor`` before they prune: one leaves the search exact, more skips shards and subtrees sooner.

Equal vectors are equally near to anything, so of each vector the rows with the k + 1 smallest ids stand for all, and a
vector is searched once for all queries that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewell.llm.common import Scratch
from clausewell.llm.vantage_tree import Search, Tree, distances, grow, scaled, units

#: Rows of a shard, queries of a block, and the bounds of the pivots that every task holds.
SHARD, BLOCK = 4096, 512
MOST_PIVOTS, MOST_PIVOT_BYTES = 4096, 8 << 20


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dim, digest and raw (doubles as bytes) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.array([x + 0.0 for x in v], np.float64) for v in batch.column(1).to_pylist()]
            keep = [k for k, v in enumerate(held) if len(v) and np.isfinite(v).all() and v.any()]
            raw = [held[k].tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(held[k]) for k in keep], pa.int32()), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "dim", "digest", "raw"])

    whole = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull()) & F.col(key).isNotNull()
    return rows.filter(whole).select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, "id bigint, dim int, digest binary, raw binary")


def _first_of_each(rows: DataFrame, k: int) -> DataFrame:
    """The rows with the ``k`` smallest ids of every vector; tasks drop the others before the shuffle."""
    line = Window.partitionBy("dim", "digest").orderBy("id")
    return rows.withColumn("_cw_n", F.row_number().over(line)).filter(F.col("_cw_n") <= k).drop("_cw_n")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


class Pivots:
    """Unit vectors that divide the rows of one number of components into cells."""

    def __init__(self, rows: list):
        self.of = {d: units(scaled(np.stack([np.frombuffer(r["raw"]) for r in rows if r["dim"] == d]))) for d in {r["dim"] for r in rows}}

    def away(self, dim: int, vectors: np.ndarray) -> np.ndarray:
        """Distances to all pivots; vectors with a number of components that no pivot has are one cell around nothing."""
        found = self.of.get(dim)
        return np.zeros((len(vectors), 1)) if found is None else np.stack([distances(units(scaled(vectors)), p) for p in found], 1)


def _pivots(rows: DataFrame, n: int, shard: int) -> Pivots:
    """About one pivot per shard's worth of rows: those whose digests have the smallest hashes, at most ``MOST_PIVOTS`` and 8 MB."""
    widest = rows.agg(F.max("dim")).first()[0] or 1
    wanted = max(1, min(-(-n // shard), MOST_PIVOTS, MOST_PIVOT_BYTES // (8 * widest)))
    return Pivots(rows.select("dim", "digest", "raw").orderBy(F.xxhash64("digest"), "digest").limit(wanted).collect())


def _in_cells(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``rows`` with their cell and their distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                far = pivots.away(int(dim), _matrix(batch.column(3).take(pa.array(at)), int(dim)))
                cell[at] = far.argmin(1)
                away[at] = far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["id", "dim", "digest", "raw", "cell", "away"])

    return rows.select("id", "dim", "digest", "raw").mapInArrow(run, "id bigint, dim int, digest binary, raw binary, cell int, away double")


def _part(parts: Column) -> Column:
    """The shard of a cell in which a vector is; rows of one vector are together."""
    return F.pmod(F.xxhash64("digest"), parts).cast("int")


KEYS = ["dim", "cell", "part"]
TREE = "dim int, cell int, part int, ids array<bigint>, raw binary, bounds binary"
FOUND = "digest binary, dim int, id bigint, score double"


def _planted(table: pa.Table) -> pa.Table:
    """One shard's rows as its tree."""
    dim = table["dim"][0].as_py()
    table = table.sort_by([("id", "ascending")])
    vectors = _matrix(table["raw"], dim)
    order, bounds = grow(vectors)
    ids = table["id"].to_numpy()[order]
    return pa.table({k: table[k][:1] for k in KEYS} | {"ids": [ids.tolist()], "raw": [vectors[order].tobytes()], "bounds": [bounds.tobytes()]})


def _searched(trees: DataFrame, asked: DataFrame, k: int, factor: float, block: int) -> DataFrame:
    """FOUND of queries (KEYS, digest, raw, reach) in the shards that they name, in blocks of about ``block`` queries."""
    sizes = asked.groupBy(*KEYS).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = asked.join(sizes, KEYS).withColumn("block", F.pmod(F.xxhash64("digest", F.lit(1)), "blocks"))
    blocks = dealt.groupBy(*KEYS, "block").agg(F.collect_list(F.struct("digest", "raw", "reach")).alias("q"))
    # a tree's row is the larger side, so that AQE may split the shards that many blocks ask for
    pairs = blocks.join(trees.withColumnRenamed("raw", "rows"), KEYS).select("dim", "q", "ids", "rows", "bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, one = batch.column(0)[i].as_py(), batch.column(1)[i].values
                digests = one.field("digest")
                search = Search(_matrix(one.field("raw"), dim), k, one.field("reach").to_numpy(), factor)
                ids = batch.column(2)[i].values.to_numpy()
                search.visit(Tree(ids, np.frombuffer(batch.column(3)[i].as_buffer()).reshape(-1, dim), np.frombuffer(batch.column(4)[i].as_buffer()).reshape(-1, 4)))
                q, place = np.nonzero(np.isfinite(search.scores))
                yield pa.RecordBatch.from_arrays(
                    [digests.take(pa.array(q)), pa.array(np.full(len(q), dim, np.int32)), pa.array(search.ids[q, place]), pa.array(search.scores[q, place])], names=["digest", "dim", "id", "score"])

    return pairs.mapInArrow(run, FOUND)


def _routed(asked: DataFrame, pivots: Pivots, cells: dict[tuple[int, int], tuple[float, float, int]], factor: float) -> DataFrame:
    """(KEYS, digest, raw, reach): every shard but a query's first one that its reach does not exclude."""
    dims = {d: sorted(c for e, c in cells if e == d) for d, _ in cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column(0).to_pylist()):
                at = pa.array(np.flatnonzero(batch.column(0).to_numpy() == dim))
                mine = batch.take(at)
                far = pivots.away(dim, _matrix(mine.column(4), dim))
                reach, home, first = (mine.column(k).to_numpy() for k in (5, 1, 2))
                for cell in dims[dim]:
                    lo, hi, parts = cells[dim, cell]
                    bound = np.maximum(lo - far[:, cell], far[:, cell] - hi) if dim in pivots.of else np.zeros(len(reach))
                    go = bound * factor <= reach + 1e-7
                    for part in range(parts):
                        to = pa.array(np.flatnonzero(go & ((home != cell) | (first != part))))
                        if len(to):
                            fixed = [pa.array(np.full(len(to), x, np.int32)) for x in (dim, cell, part)]
                            yield pa.RecordBatch.from_arrays([*fixed, *(mine.column(k).take(to) for k in (3, 4, 5))], names=[*KEYS, "digest", "raw", "reach"])

    return asked.select(*KEYS, "digest", "raw", "reach").mapInArrow(run, "dim int, cell int, part int, digest binary, raw binary, reach double")


def nearest(
    rows: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding",
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank from 1, ``key`` and score: for each row that ``is_query`` selects, the ``k`` other rows with the greatest cosine.

    Of equal scores smaller ids come first. Vectors that are null, empty or zero, or hold a null or a component that is
    not finite, take no part, nor do rows without an id; vectors are compared with those of as many components only.
    Rows repeated under one id are candidates each, but never for their own id; a query repeated under one id is asked
    once per different vector. Fewer candidates give fewer rows; an empty table gives none; other columns are not read.
    """
    usable = scratch.save(_usable(rows, key, vector), "usable")
    queries = scratch.save(_usable(rows.filter(is_query), key, vector), "queries").select("id", "dim", "digest", "raw")
    kept = scratch.save(_first_of_each(usable, k + 1), "kept")
    n = kept.count()
    pivots = _pivots(kept, n, shard)
    placed = scratch.save(_in_cells(kept, pivots), "cells")
    stats = placed.groupBy("dim", "cell").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    stats = scratch.save(stats, "stats")
    # one row per pivot, and one per number of components
    cells = {(r["dim"], r["cell"]): (r["lo"], r["hi"], r["parts"]) for r in stats.collect()}
    sharded = placed.join(F.broadcast(stats.select("dim", "cell", "parts")), ["dim", "cell"]).withColumn("part", _part(F.col("parts")))
    trees = scratch.save(sharded.select(*KEYS, "id", "raw").groupBy(*KEYS).applyInArrow(_planted, TREE), "trees")
    asked = _in_cells(_first_of_each(queries, 1), pivots).join(F.broadcast(stats.select("dim", "cell", "parts")), ["dim", "cell"])
    asked = scratch.save(asked.select("dim", "cell", _part(F.col("parts")).alias("part"), "digest", "raw", F.lit(float("inf")).alias("reach")), "asked")
    home = scratch.save(_searched(trees, asked, k + 1, factor, block), "home")
    # the distance of the last neighbour, where there are enough
    kth = home.groupBy("dim", "digest").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    near = asked.drop("reach").join(kth, ["dim", "digest"], "left").withColumn(
        "reach", F.when(F.col("n") > k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)))).otherwise(float("inf")))
    routes = scratch.save(_routed(near, pivots, cells, factor), "routes")
    found = home.unionByName(_searched(trees, routes, k + 1, factor, block))
    line = Window.partitionBy("dim", "digest").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= k + 1)
    lists = best.groupBy("dim", "digest").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("best"))
    others = queries.select("dim", "digest", F.col("id").alias("query_id")).distinct().join(lists, ["dim", "digest"])
    others = others.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return others.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))


_V = "embedding::double[]"
ORACLE = f"""with v as (select vec_id, {_V} as v, sqrt(list_inner_product({_V}, {_V})) as size from embeddings where embedding is not null and len(embedding) > 0 and vec_id is not null
    and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) and not list_contains([list_max(list_transform(embedding, lambda x: abs(x)))], 0)),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) / (a.size * b.size) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v))
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""
