"""Summaries of usage logs and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewell.functions.ranks import LOWER, UPPER, at_ranks, nearest
from clausewell.functions.text import clamped


def summary(log: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes, mean, sum, nearest-rank percentiles and both medians of ``value`` per group, all exact."""
    ranks = at_ranks(log, group, value, {"p50": nearest(0.5), "p95": nearest(0.95), "upper_median": UPPER, "low": LOWER})
    totals = log.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.sum(value), 4).alias("total"))
    return ranks.join(totals, group).select(group, "n", "least", "most", "mean", "total", "p50", "p95", "upper_median", F.round((F.col("low") + F.col("upper_median")) / 2, 6).alias("median"))


def refused(log: DataFrame) -> DataFrame:
    """The log with ``was_refused``: flagged so, or no clause judged, as older rows tell it."""
    return log.withColumn("was_refused", F.coalesce("refused", F.lit(False)) | (F.col("clauses") == 0))


def scan_summary(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row over a scan log: what was left out, sizes, cost, nearest-rank seconds, calls, flags and scans per client.

    Refusals go first, then scans outside of ``low`` to ``high`` clauses, then cache hits. Clients are few; theirs is
    one text ``name:count`` in the order of names, ``unknown`` for rows without one.
    """
    marked = refused(log)
    scans = marked.filter("not was_refused")
    if low is not None:
        scans = scans.filter(F.col("clauses").between(low, high))
    hit = F.coalesce("cache_hit", F.lit(False))
    paid = scans.filter(~hit)
    seconds = at_ranks(paid.withColumn("all_scans", F.lit(0)), "all_scans", "seconds", {"p50_seconds": nearest(0.5), "p95_seconds": nearest(0.95)})
    mean, flagged = (lambda c, d: F.round(F.avg(c), d)), (lambda c: F.count_if(F.coalesce(c, F.lit(False))))
    main = paid.agg(
        F.count("*").alias("scans"), F.min("clauses").alias("clauses_min"), F.max("clauses").alias("clauses_max"), mean("clauses", 1).alias("mean_clauses"),
        mean("cost_usd", 4).alias("mean_cost_usd"), F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"), F.max("seconds").alias("max_seconds"),
        mean("llm_calls", 1).alias("mean_llm_calls"), mean("embedding_calls", 1).alias("mean_embedding_calls"), F.count_if(F.coalesce("clauses_total", F.lit(0)) > 0).alias("partial_scans"),
        flagged("gate_flagged").alias("gate_flagged"), F.count_if(F.col("jurisdiction").isNotNull()).alias("jurisdiction_mismatches"))
    out = marked.agg(F.count_if("was_refused").alias("refusals_excluded"))
    hits = scans.agg(F.count_if(hit).alias("cache_hits_excluded"))
    clients = paid.groupBy(F.coalesce("client", F.lit("unknown")).alias("client")).agg(F.count("*").alias("n"))
    clients = clients.agg(F.array_join(F.array_sort(F.collect_list(F.concat("client", F.lit(":"), F.col("n").cast("string")))), ",").alias("by_client"))
    one = main  # one row each, so these joins on nothing are no products
    for side in (out, hits, clients):
        one = one.join(side, F.lit(True))
    return one.join(seconds.select("p50_seconds", "p95_seconds"), F.lit(True), "left")


def verdict_shares(log: DataFrame) -> DataFrame:
    """Scans and clauses with recorded verdicts, the judges they rest on, and the share of each verdict; no row without any."""
    known = log.filter(F.col("verdicts").isNotNull())
    total = lambda v: F.sum(F.col("verdicts")[v])
    judged = total("red") + total("yellow") + total("green")
    table = known.agg(
        F.count("*").alias("verdict_scans"), judged.alias("verdict_clauses"), F.array_join(F.array_sort(F.collect_set(F.coalesce("judge", F.lit("unrecorded")))), ",").alias("judges"),
        *(F.round(F.try_divide(total(v), judged), 4).alias(v) for v in ("red", "yellow", "green")))
    return table.filter("verdict_clauses > 0")


def ask_summary(log: DataFrame) -> DataFrame:
    """One row over an ask log: questions routed to retrieval alone, the chitchat left out, cost, seconds, calls and tokens."""
    routed = log.filter("routed_to_retrieval")
    seconds = at_ranks(routed.withColumn("all_asks", F.lit(0)), "all_asks", "seconds", {"p50_seconds": nearest(0.5), "p95_seconds": nearest(0.95)})
    mean = lambda c, d: F.round(F.avg(c), d)
    main = routed.agg(
        F.count("*").alias("questions"), mean("cost_usd", 5).alias("mean_cost_usd"), F.round(F.sum("cost_usd"), 5).alias("total_cost_usd"), F.max("seconds").alias("max_seconds"),
        mean("llm_calls", 2).alias("mean_llm_calls"), mean("embedding_calls", 2).alias("mean_embedding_calls"), mean("prompt_tokens", 0).alias("mean_prompt_tokens"),
        F.round(F.sum("cached_prompt_tokens") / F.greatest(F.sum("prompt_tokens"), F.lit(1)), 3).alias("cached_prompt_token_share"))
    chat = log.agg(F.count_if(~F.coalesce("routed_to_retrieval", F.lit(False))).alias("chitchat_excluded"))
    return main.join(chat, F.lit(True)).join(seconds.select("p50_seconds", "p95_seconds"), F.lit(True), "left")


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model and kind of call: calls, tokens and cost. A model without a price costs nothing, but its calls count.

    ``calls``: model, kind (completion or embedding), prompt_tokens, completion_tokens, and details, a JSON text whose
    ``$.prompt_tokens_details.cached_tokens`` may be absent. ``prices``: model, prompt_price, completion_price per token.
    """
    cached = F.coalesce(F.get_json_object("details", "$.prompt_tokens_details.cached_tokens").try_cast("bigint"), F.lit(0))
    sums = calls.groupBy("model", "kind").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum(cached).alias("cached_prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    cost = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    return sums.join(prices, "model", "left").withColumn("cost_usd", F.round(F.coalesce(cost, F.lit(0.0)), 6)).drop("prompt_price", "completion_price")


def costs(log: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Calls and cost per key; a key without a price costs nothing, but its calls count. ``prices`` is a small dimension."""
    calls = log.groupBy(key).agg(F.count("*").alias("calls"), F.sum("value").alias("units"))
    return calls.join(prices, key, "left").select(key, "calls", F.round(F.coalesce(F.col("units") * F.col("price"), F.lit(0.0)), 4).alias("cost"))


def recent_turns(history: DataFrame, most: int = 10, most_chars: int = 6000) -> DataFrame:
    """The last ``most`` turns of every conversation, each clamped; the limit is applied before the shuffle, too."""
    line = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    last = history.withColumn("back", F.row_number().over(line)).filter(F.col("back") <= most)
    return last.select("conv_id", "turn", "back", "role", clamped(F.col("text"), most_chars).alias("text"))


def recently_used(uses: DataFrame, key: str, used: str, most: int = 32) -> DataFrame:
    """What a cache of ``most`` entries holds after all uses: the keys used last."""
    last = uses.groupBy(key).agg(F.max(used).alias("last_used"))
    return last.orderBy(F.desc("last_used"), key).limit(most)
