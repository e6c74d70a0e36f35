"""The engine's front: ingestion, configured retrieval, scans, evaluation and log summaries, DataFrame in and DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.operators import evaluation, logs, providers, retrieval
from clausewell.operators.corpus import numbered
from clausewell.operators.scan import findings, rule_judge, scan
from clausewell.operators.splitting import naive_chunks

#: The least depth of each list before two kinds of search are fused.
HYBRID_DEPTH = 20
#: A scan cuts a clause's text to this many characters before it searches with it; questions are searched with whole.
MOST_CLAUSE = 1200


@dataclass(frozen=True)
class RetrievalConfig:
    """Which stages a retrieval has, and how deep its lists go."""

    hybrid: bool = False
    rewritten: bool = False
    graded: bool = False
    reranked: bool = False
    section_completion: bool = False
    retrieval_k: int = 20
    final_k: int = 10
    most_query: int | None = None

    @property
    def candidate_k(self) -> int:
        return max(self.retrieval_k, HYBRID_DEPTH) if self.hybrid else self.retrieval_k


#: Retrieval for a scan: six hits, no further stage.
SCAN = RetrievalConfig(retrieval_k=6, final_k=6, most_query=MOST_CLAUSE)


class Engine:
    """Documents in chunks, searched and scanned. ``docs``: doc_id and text; ``vectors``: doc_id and embedding of whole
    documents, which then are the unit of retrieval instead of chunks. ``provider`` answers where a stage asks a model
    and no table of answers is given."""

    def __init__(self, docs: DataFrame, vectors: DataFrame | None = None, provider: providers.Provider | None = None, policy: providers.Policy = providers.Policy()):
        self.docs, self.vectors, self.provider, self.policy = docs, vectors, provider, policy
        self.keys = ["doc_id"] if vectors is not None else ["doc_id", "ord"]
        self.chunks = docs.withColumnRenamed("text", "content") if vectors is not None else naive_chunks(docs)
        self._index: retrieval.Index | None = None

    def ingest(self, state: str) -> DataFrame:
        """The chunks with ids ``<state>-<n>`` in corpus order."""
        return numbered(naive_chunks(self.docs), state, ["doc_id", "ord"])

    def build_index(self) -> retrieval.Index:
        """The index of the chunks, built on the first call."""
        self._index = self._index or retrieval.build_index(self.chunks, self.keys, "content")
        return self._index

    def _base(self, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
        """One ranked list per query: vectors, terms, or both fused."""
        k, lists = config.candidate_k, []
        if self.vectors is not None and "embedding" in queries.columns:
            asked = queries.select(F.col("item_id").alias("doc_id"), "embedding")
            lists.append(retrieval.dense(asked, self.vectors, "doc_id", "embedding", k).select(F.col("query_id").alias("item_id"), "doc_id", "rank"))
        if config.hybrid or not lists:
            cut = queries.withColumn("text", F.substring("text", 1, config.most_query)) if config.most_query else queries
            lists.append(retrieval.search(self.build_index(), cut, "item_id", k).select("item_id", *self.keys, "rank"))
        return lists[0] if len(lists) == 1 else self._fused(lists, config.retrieval_k)

    def _fused(self, lists: list[DataFrame], k: int) -> DataFrame:
        every = None
        for n, one in enumerate(lists):
            rows = one.select("item_id", F.struct(*self.keys).alias("key"), "rank", F.lit(n).alias("list_no"))
            every = rows if every is None else every.unionByName(rows)
        return retrieval.fuse(every, "item_id", "key", k).select("item_id", "key.*", "rank")

    def retrieve(
        self, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), rewrites: DataFrame | None = None, grades: DataFrame | None = None,
        orders: DataFrame | None = None,
    ) -> DataFrame:
        """item_id, the keys and position.

        ``rewrites`` (item_id, angle, text): the angle ``plain`` is fused in when rewritten, the angle ``statutory`` when
        graded and ``grades`` (item_id, sufficient) finds the first hits insufficient. ``orders`` (item_id, ranks) is the
        reranker's permutation. What is not given is asked of the provider, if there is one.
        """
        hits = self._base(queries, config)
        if self.provider and rewrites is None and (config.rewritten or config.graded):
            rewrites = providers.rewrites(queries, self.provider, policy=self.policy)
        if config.rewritten and rewrites is not None:
            hits = self._fused([hits, self._base(rewrites.filter("angle = 'plain'"), config)], config.retrieval_k)
        if self.provider and grades is None and config.graded:
            grades = providers.graded(self.contents(hits), self.provider, policy=self.policy)
        if config.graded and rewrites is not None and grades is not None:
            weak = rewrites.filter("angle = 'statutory'").join(grades.filter("not sufficient").select("item_id"), "item_id", "left_semi")
            hits = self._fused([hits, self._base(weak, config)], config.retrieval_k)
        if self.provider and orders is None and config.reranked:
            orders = providers.orders(self.contents(hits), self.provider, most=config.retrieval_k, policy=self.policy)
        if config.reranked and orders is not None:
            placed = retrieval.reranked(hits, orders, "item_id")
            line = F.row_number().over(retrieval.Window.partitionBy("item_id").orderBy("position"))
            hits = placed.withColumn("rank", line).drop("position")
        hits = hits.filter(F.col("rank") <= config.final_k)
        if config.section_completion:
            return retrieval.complete_sections(hits, self.chunks, "item_id", "doc_id", "ord").drop("branch")
        return hits.select("item_id", *self.keys, F.col("rank").alias("position"))

    def contents(self, hits: DataFrame) -> DataFrame:
        """``hits`` with the content of each."""
        return hits.join(self.chunks.select(*self.keys, "content"), self.keys)

    def ask(self, questions: DataFrame, config: RetrievalConfig = RetrievalConfig(), **stages: DataFrame) -> DataFrame:
        """Per question the retrieved texts in order, joined: what an answering model is given."""
        hits = self.contents(self.retrieve(questions, config, **stages))
        ordered = F.array_sort(F.collect_list(F.struct("position", "content")))
        return hits.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("context"), F.count("*").alias("retrieved"))

    def evaluate(self, hits: DataFrame, expected: DataFrame) -> DataFrame:
        """Retrieval metrics of hits (item_id, doc_id, position) against the one expected document of every query."""
        found = hits.join(expected, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("position").alias("rank"))
        return evaluation.retrieval_metrics(expected.select("item_id").distinct().join(found, "item_id", "left"))

    def scan(self, judge: Callable[[Column], Column] = rule_judge) -> DataFrame:
        return scan(self.docs, judge)

    def findings(self, judge: Callable[[Column], Column] = rule_judge) -> DataFrame:
        """Verdicts of ``judge``, or of the provider where there is one, then with the status and attempts of each."""
        if self.provider:
            return providers.judged(findings(self.docs, lambda clause: F.lit(None).cast("string")).drop("verdict"), self.provider, policy=self.policy)
        return findings(self.docs, judge)

    def clause_hits(self, config: RetrievalConfig = SCAN) -> DataFrame:
        """doc_id, index, and the keys (as ``hit``) and position of what a scan retrieves for every clause of every document."""
        clauses = findings(self.docs, lambda clause: F.lit("")).withColumn("item_id", F.struct("doc_id", "index"))
        hits = self.retrieve(clauses.select("item_id", F.col("clause").alias("text")), config)
        return hits.select("item_id.doc_id", "item_id.index", F.struct(*self.keys).alias("hit"), "position")

    @staticmethod
    def summarize_logs(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
        return logs.scan_summary(log, low, high)
