"""Calls of an outside model as a Spark stage: every different prompt is asked once, in batches, with bounded retries,
and what comes of it, refusals and failures included, is a row of a written table.

A provider is any picklable object with ``answer(prompts) -> list``: one reply per prompt, a string or an exception.
``Refused`` is a decision and is never retried; any other exception is, alone for its prompt, until the policy's
attempts or its time are used up. An exception that the call itself raises stands for all prompts of the call.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.sources.tables import grown_table, shared_folder


class Refused(Exception):
    """The provider declines; asking again would not change that."""


class Provider(Protocol):
    def answer(self, prompts: list[str]) -> list[str | Exception]: ...


@dataclass(frozen=True)
class Policy:
    """Prompts of a call, calls at once, attempts of a prompt, seconds until no further attempt begins, and seconds between
    attempts: ``least``, then doubled each time up to ``most``."""

    batch: int = 100
    parallel: int = 8
    attempts: int = 5
    budget: float = 300.0
    least: float = 10.0
    most: float = 240.0

    def wait(self, attempt: int) -> float:
        """Seconds after the attempt of that number, from 1."""
        return min(self.most, self.least * 2 ** (attempt - 1))


REPLY = "answer string, status string, attempts int, error string"


def call(provider: Provider, prompts: list[str], policy: Policy, sleep=time.sleep, clock=time.monotonic) -> list[tuple]:
    """(answer, status, attempts, error) of each prompt of one call; the status is answered, refused or failed."""
    out: list[tuple] = [()] * len(prompts)
    began, waiting = clock(), list(range(len(prompts)))
    for attempt in range(1, policy.attempts + 1):
        try:
            replies = provider.answer([prompts[k] for k in waiting])
            if len(replies) != len(waiting):
                raise ValueError(f"{len(replies)} replies to {len(waiting)} prompts")
        except Exception as error:  # whatever a provider raises is this call's outcome, not the job's
            replies = [error] * len(waiting)
        again = []
        for k, reply in zip(waiting, replies, strict=True):
            if isinstance(reply, Refused):
                out[k] = (None, "refused", attempt, str(reply))
            elif isinstance(reply, Exception):
                out[k] = (None, "failed", attempt, f"{type(reply).__name__}: {reply}")
                again.append(k)
            else:
                out[k] = (reply, "answered", attempt, None)
        waiting = again
        if not waiting or attempt == policy.attempts or clock() - began + policy.wait(attempt) > policy.budget:
            return out
        sleep(policy.wait(attempt))
    return out


def _prompt_digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    """One row per prompt of a store: of several tries the answered one, else the one with the most attempts."""
    rows = grown_table(spark, store, f"digest string, {REPLY}")
    best = F.max_by(F.struct("answer", "status", "attempts", "error"), F.struct((F.col("status") == "answered").alias("a"), F.col("attempts"), F.col("answer")))
    return rows.groupBy("digest").agg(best.alias("r")).select("digest", "r.*")


def ask(prompts: DataFrame, provider: Provider, policy: Policy = Policy(), store: str | None = None) -> DataFrame:
    """(digest, answer, status, attempts, error) for every different value of the column ``prompt``; null is never asked.

    Replies are appended to ``store``, a folder that all executors share, and prompts that it holds an answer to are not
    asked again, so that a rerun asks for what is new or has failed. At most ``policy.parallel`` tasks call at a time.
    """
    spark = prompts.sparkSession
    wanted = prompts.filter(F.col("prompt").isNotNull()).select(_prompt_digest(F.col("prompt")).alias("digest"), "prompt").dropDuplicates(["digest"])
    if store is not None:
        wanted = wanted.join(_stored(spark, store).filter("status = 'answered'").select("digest"), "digest", "left_anti")

    store = store or shared_folder(spark, "replies")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), policy.batch):
                part = frame.iloc[at : at + policy.batch]
                replies = pd.DataFrame(call(provider, part["prompt"].tolist(), policy), columns=["answer", "status", "attempts", "error"])
                yield replies.assign(digest=part["digest"].to_numpy())[["digest", *replies.columns]]

    calls = wanted.repartition(policy.parallel, "digest").mapInPandas(run, f"digest string, {REPLY}")
    calls.write.mode("append").parquet(store)
    return _stored(spark, store)


def with_replies(rows: DataFrame, prompt: Column, provider: Provider, policy: Policy = Policy(), store: str | None = None) -> DataFrame:
    """``rows`` with ``reply``, a struct of REPLY; rows with equal prompts share one, rows without a prompt have null."""
    keyed = rows.withColumn("_cw_digest", _prompt_digest(prompt))
    replies = ask(rows.select(prompt.alias("prompt")), provider, policy, store)
    found = replies.select(F.col("digest").alias("_cw_digest"), F.struct("answer", "status", "attempts", "error").alias("reply"))
    return keyed.join(found, "_cw_digest", "left").drop("_cw_digest")


def _parsed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``name`` from the reply's answer, and ``status``, malformed where an answer does not hold it."""
    found = rows.withColumn(name, value)
    status = F.when((F.col("reply.status") == "answered") & F.col(name).isNull(), "malformed").otherwise(F.col("reply.status"))
    return found.withColumns({"status": status, "attempts": F.col("reply.attempts")}).drop("reply")


#: Verdicts of a judge, and kinds of a document.
VERDICTS, KINDS = ("red", "yellow", "green"), ("lease_agreement", "document_about_leases", "other")
#: A grader sees the beginnings of the first hits.
GRADED_HITS, GRADED_CHARS = 8, 500


def judged(rows: DataFrame, provider: Provider, text: str = "clause", **options) -> DataFrame:
    """``rows`` with verdict, status and attempts of their ``text``."""
    answer = F.lower(F.trim("reply.answer"))
    return _parsed(with_replies(rows, F.concat(F.lit("judge\n"), text), provider, **options), "verdict", F.when(answer.isin(*VERDICTS), answer))


def classified(docs: DataFrame, provider: Provider, text: str = "text", **options) -> DataFrame:
    """``docs`` with the gate's kind and jurisdiction, status and attempts; the answer is a JSON object of both."""
    rows = with_replies(docs, F.concat(F.lit("gate\n"), text), provider, **options)
    found = _parsed(rows, "gate", F.from_json("reply.answer", "kind string, jurisdiction string"))
    known = F.col("gate.kind").isin(*KINDS)
    status = F.when((F.col("status") == "answered") & ~F.coalesce(known, F.lit(False)), "malformed").otherwise(F.col("status"))
    return found.withColumns({"status": status, "kind": F.when(known, F.col("gate.kind")), "jurisdiction": F.when(known, F.col("gate.jurisdiction"))}).drop("gate")


def _contexts(hits: DataFrame, query: str, content: str, most: int, chars: int | None) -> DataFrame:
    """(query, context): what a query's first hits hold, numbered by their rank; a hit without content is an empty one."""
    held = F.coalesce(content, F.lit(""))
    piece = F.substring(held, 1, chars) if chars else held
    lines = F.sort_array(F.collect_list(F.struct("rank", piece.alias("t"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["t"])), "\n")
    return hits.filter(F.col("rank") <= most).groupBy(query).agg(text.alias("context"))


def graded(hits: DataFrame, provider: Provider, query: str = "item_id", content: str = "content", **options) -> DataFrame:
    """(query, sufficient, status, attempts) of hits (query, rank, content): whether the first hits suffice; null counts as not."""
    rows = with_replies(_contexts(hits, query, content, GRADED_HITS, GRADED_CHARS), F.concat(F.lit("grade\n"), "context"), provider, **options)
    answer = F.lower(F.trim("reply.answer"))
    found = _parsed(rows, "sufficient", F.when(answer.isin("true", "false"), answer == "true"))
    return found.select(query, F.coalesce("sufficient", F.lit(False)).alias("sufficient"), "status", "attempts")


def orders(hits: DataFrame, provider: Provider, query: str = "item_id", content: str = "content", most: int = 20, **options) -> DataFrame:
    """(query, ranks, status, attempts): the permutation that a reranker answers, a JSON list of ranks.

    A query whose reply is no list keeps its order.
    """
    rows = with_replies(_contexts(hits, query, content, most, None), F.concat(F.lit("rerank\n"), "context"), provider, **options)
    found = _parsed(rows, "ranks", F.from_json("reply.answer", "array<int>"))
    kept = hits.filter(F.col("rank") <= most).groupBy(query).agg(F.sort_array(F.collect_list("rank")).alias("_cw_kept"))
    return found.join(kept, query).select(query, F.coalesce("ranks", "_cw_kept").alias("ranks"), "status", "attempts")


#: The angles from which a question is asked again.
ANGLES = ("plain", "statutory")


def rewrites(queries: DataFrame, provider: Provider, query: str = "item_id", **options) -> DataFrame:
    """(query, angle, text, status, attempts): the question in other words; where none come, the question itself."""
    each = queries.select(query, F.col("text").alias("question"), F.explode(F.array(*map(F.lit, ANGLES))).alias("angle"))
    rows = with_replies(each, F.concat(F.lit("rewrite "), "angle", F.lit("\n"), "question"), provider, **options)
    found = _parsed(rows, "text", F.nullif(F.trim("reply.answer"), F.lit("")))
    return found.select(query, "angle", F.coalesce("text", "question").alias("text"), "status", "attempts")


@dataclass(frozen=True)
class Rules:
    """A provider without a model: of (pattern, answer) the first whose pattern the prompt holds, else ``default``."""

    rules: tuple[tuple[str, str], ...]
    default: str | None = None

    def answer(self, prompts: list[str]) -> list[str | Exception]:
        found = []
        for prompt in prompts:
            reply = next((answer for pattern, answer in self.rules if re.search(pattern, prompt)), self.default)
            found.append(Refused("no rule") if reply is None else reply)
        return found


@dataclass(frozen=True)
class Lookup:
    """A provider that answers from a table; what it lacks it refuses."""

    table: dict[str, str]

    def answer(self, prompts: list[str]) -> list[str | Exception]:
        return [self.table.get(p, Refused("unknown prompt")) for p in prompts]


class Faulty:
    """``provider`` behind faults that ``faults(prompt)`` sets: so many attempts fail before one is let through, none if negative."""

    def __init__(self, provider: Provider, faults):
        self.provider, self.faults, self.seen = provider, faults, {}

    def answer(self, prompts: list[str]) -> list[str | Exception]:
        out, let = [], []
        for prompt in prompts:
            before = self.seen[prompt] = self.seen.get(prompt, 0) + 1
            failing = self.faults(prompt)
            out.append(ConnectionError("out of reach") if before <= failing else Refused("declined") if failing < 0 else None)
            let += [prompt] if out[-1] is None else []
        replies = iter(self.provider.answer(let) if let else [])
        return [next(replies) if x is None else x for x in out]
