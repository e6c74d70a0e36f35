"""An index that is kept up to date: segments written once, tombstones for what they no longer hold, and a log of versions.

An update compares content hashes, cuts only new and changed documents into terms, and writes these as one more segment;
rows of older segments that changed or went are listed as gone. Files are never changed. A version is one row of the log,
written last, so that readers see an update whole or not at all and what a failed one left is never read. A merge
writes the living rows of small segments as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.operators.retrieval import Index, build_index
from clausewell.sources.tables import grown_table

LOG = "version int, segments array<int>, gone array<int>"


@dataclass(frozen=True)
class Version:
    version: int
    segments: tuple[int, ...]
    gone: tuple[int, ...]


class SegmentedIndex:
    """An index of documents with the columns ``keys`` and ``text`` in the folder ``path``, which all executors share.

    One writer at a time; readers need no care.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], text: str = "text"):
        self.spark, self.path, self.keys, self.text = spark, path.rstrip("/"), keys, text

    def _append(self, version: Version) -> None:
        row = [(version.version, list(version.segments), list(version.gone))]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def version(self) -> Version:
        """The last whole version; of a folder without one, the empty one."""
        row = grown_table(self.spark, f"{self.path}/log", LOG).orderBy(F.desc("version")).limit(1).collect()
        return Version(row[0]["version"], tuple(row[0]["segments"]), tuple(row[0]["gone"])) if row else Version(0, (), ())

    def _union(self, name: str, numbers: tuple[int, ...]) -> DataFrame | None:
        found = None
        for k in numbers:
            rows = self.spark.read.parquet(f"{self.path}/{name}-{k}")
            rows = rows.withColumn("segment", F.lit(k)) if name == "segment" else rows
            found = rows if found is None else found.unionByName(rows)
        return found

    def live(self, at: Version | None = None) -> DataFrame | None:
        """keys, digest, length, counts and segment of the rows that the index holds; None before the first update."""
        at = at or self.version()
        rows, gone = self._union("segment", at.segments), self._union("gone", at.gone)
        if rows is None or gone is None:
            return rows
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*self.keys, "segment")]
        every = same[0]
        for one in same[1:]:
            every = every & one
        return rows.alias("r").join(gone.alias("g"), every, "left_anti")

    def update(self, docs: DataFrame) -> dict[str, int]:
        """Makes the index hold exactly ``docs``; how many rows were added, changed, removed and kept.

        Keys are unique in ``docs``. Only narrow columns of the old rows are read, and only new and changed texts are cut.
        """
        now = self.version()
        new = now.version + 1
        hashed = docs.select(*self.keys, F.sha2(F.coalesce(self.text, F.lit("")), 256).alias("digest"))
        old = self.live(now)
        if old is None:
            state = hashed.select(*self.keys, F.lit(None).cast("int").alias("segment"), F.lit("added").alias("change"))
        else:
            before = old.select(*self.keys, F.col("digest").alias("was"), "segment")
            kind = F.when(F.col("was").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("was") != F.col("digest"), "changed").otherwise("kept")
            state = hashed.join(before, self.keys, "full").select(*self.keys, "segment", kind.alias("change"))
        state.write.parquet(f"{self.path}/changes-{new}")
        state = self.spark.read.schema(state.schema).parquet(f"{self.path}/changes-{new}")
        counts = {"added": 0, "changed": 0, "removed": 0, "kept": 0} | {r["change"]: r["count"] for r in state.groupBy("change").count().collect()}
        segments, gone = now.segments, now.gone
        if counts["added"] + counts["changed"]:
            self._write(docs.join(state.filter("change in ('added', 'changed')").select(*self.keys), self.keys, "left_semi"), new)
            segments += (new,)
        if counts["changed"] + counts["removed"]:
            state.filter("change in ('changed', 'removed')").select(*self.keys, "segment").write.parquet(f"{self.path}/gone-{new}")
            gone += (new,)
        self._append(Version(new, segments, gone))
        return counts

    def _write(self, docs: DataFrame, number: int) -> None:
        rows = docs.select(F.struct(*self.keys, F.sha2(F.coalesce(self.text, F.lit("")), 256).alias("digest")).alias("row"), F.col(self.text).alias("text"))
        index = build_index(rows, ["row"])
        index.rows.select("row.*", "length", "counts").write.parquet(f"{self.path}/segment-{number}")

    def merge(self, most: int = 8) -> int:
        """Writes the living rows of all but the ``most - 1`` largest segments as one; how many segments went into it."""
        now = self.version()
        if len(now.segments) <= most:
            return 0
        rows = self.live(now)
        sizes = sorted(((r["count"], r["segment"]) for r in rows.groupBy("segment").count().collect()), reverse=True)
        large = tuple(sorted(s for _, s in sizes[: most - 1]))
        new = now.version + 1
        rows.filter(~F.col("segment").isin(list(large))).drop("segment").write.parquet(f"{self.path}/segment-{new}")
        # tombstones of the merged segments name rows that no listed segment has any more
        self._append(Version(new, (*large, new), now.gone))
        return len(now.segments) - len(large)

    def index(self) -> Index:
        """What ``retrieval.search`` reads: the living rows, their number and mean length."""
        rows = self.live()
        if rows is None:
            raise ValueError("the index has no version yet")
        stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).first()
        return Index(rows.select(*self.keys, "length", "counts"), self.keys, stats["n"], stats["mean"])
