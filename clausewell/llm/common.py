"""Helpers shared by the corpus operators: the shared scratch folder, joins that stay even under hot keys,
Bloom words, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.functions.workers import emptied as emptied

#: Word separators of all contracts: the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a local session gets a temporary folder; any other master must name one, since a
    machine-local folder would be invisible to the other executors.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("clausewell.scratch", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="clausewell-")
    spark.conf.set("clausewell.scratch", root)
    return root


class Scratch:
    """Tables written for one run under the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one written table, or all of this run's."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        target = hadoop.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own(column: Column, default: str = "") -> Column:
    """Null text counts as empty."""
    return F.coalesce(column, F.lit(default))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with one row per group, even when one group holds a large share of the rows.

    ``groups`` is a written table with the group's number of rows in ``size``. At most ``share`` groups can hold
    1/``share`` of ``total`` rows each, so these are broadcast with a proven bound; the other groups are small and
    go through a shuffled join.
    """
    hot = groups.filter(F.col(size) * share >= F.lit(total))
    cold = groups.filter(F.col(size) * share < F.lit(total))
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys)
    return near.unionByName(rest)


#: Edges, of 16 bytes each, that one task may join; a larger graph takes rounds of joins.
ONE_TASK = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches by them."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(places, 2)
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[u], parent[v])
        new = parent.copy()
        np.minimum.at(new, parent[u], low)
        np.minimum.at(new, parent[v], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, parent):
            return nodes, nodes[parent]
        parent = new


def contracted(edges: DataFrame, with_roots: bool) -> DataFrame:
    """(a, b): every node of a task's edges, and the smallest node that it reaches by these edges alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy() for c in batch.columns) for batch in batches]
        if held:
            nodes, roots = _roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            kept = np.ones(len(nodes), bool) if with_roots else nodes != roots
            for at in range(0, int(kept.sum()), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[kept][at : at + 100_000]) for x in (nodes, roots)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(lambda batches: emptied(run(batches)), "a bigint, b bigint")


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch, label: str, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node of its component.

    ``edges`` has bigint columns a and b. Up to ``one_task`` edges, counted, are joined by one task. Of more, every task
    first joins its own; then large-star and small-star steps alternate until the edges no longer change: each step is
    one aggregation by node (the minimum is pre-aggregated before the shuffle) and one join that attaches it, and every
    round is written to the shared folder, so lineage stays short. The number of edges never grows.
    """
    edges = scratch.save(edges.filter("a <> b").select("a", "b"), f"{label}-edges")
    if edges.count() <= one_task:
        return scratch.save(contracted(edges.coalesce(1), True), f"{label}-roots").withColumnsRenamed({"a": "node", "b": "root"})
    now = scratch.save(contracted(edges, False).distinct(), f"{label}-0")
    state = _signature(now)
    for k in range(1, most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.save(large, f"{label}-{k}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # one aggregation gives both the smallest neighbour and the other neighbours that must point to it
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        now = scratch.save(small, f"{label}-{k}")
        new = _signature(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
