"""Studies around the engine: ranks by section, lengths, answers, jurisdictions, coverage, samples and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewell.functions.ranks import LOWER, UPPER, at_ranks
from clausewell.operators.places import numbered_rows
from clausewell.operators.retrieval import bounded


def ranks_by_section(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, section, rank): the first rank of every acceptable section, null if it never arrived."""
    return expected.join(hits.groupBy("query", "section").agg(F.min("rank").alias("rank")), ["query", "section"], "left")


#: Words of a passage by which documents are looked up before the whole passage is.
ANCHOR = 5


def holders(passages: DataFrame, docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """(query, key) of every document that holds a whole passage verbatim; empty passages are in none.

    A document that holds a passage holds its second to sixth word as whole words, so documents are looked up by the
    hashes of their runs of five words, and only what is found is searched for the passage. Passages of fewer than seven
    words, which have no such run, are searched for in all documents.
    """
    asked = passages.filter(F.col(text) != "").select(query, F.col(text).alias("passage"), F.split(F.col(text), r"\s+").alias("words"))
    long = F.size("words") >= ANCHOR + 2
    anchors = asked.filter(long).select(query, "passage", F.xxhash64(F.slice("words", 2, ANCHOR)).alias("anchor"))
    words = docs.filter(F.col(text).isNotNull()).select(key, F.split(F.col(text), r"\s+").alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - ANCHOR + 1, F.lit(1))), lambda k: F.xxhash64(F.slice("words", k, ANCHOR)))
    each = words.select(key, F.explode(F.array_distinct(runs)).alias("anchor")).join(bounded(anchors.select(query, "anchor")), "anchor").select(query, key).distinct()
    found = each.join(docs.select(key, F.col(text).alias("held")), key).join(bounded(anchors.select(query, "passage")), query)
    short = docs.select(key, F.col(text).alias("held")).join(bounded(asked.filter(~long).select(query, "passage")), F.contains("held", "passage"))
    return found.filter(F.contains("held", "passage")).select(query, key).unionByName(short.select(query, key)).distinct()


def section_summary(ranks: DataFrame) -> DataFrame:
    """Hit rates and MRR on a query's best section, and the strict share: all acceptable sections arrived."""
    per = ranks.groupBy("query").agg(F.min("rank").alias("rank"), F.bool_and(F.col("rank").isNotNull()).alias("all"))
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 4)
    best = F.col("rank")
    return per.agg(
        F.count("*").alias("scored"), *(share(best <= k).alias(f"hit_{k}") for k in (1, 3, 5)), share(best.isNotNull()).alias("hit_k"),
        share(1.0 / best).alias("mrr"), share(F.col("all")).alias("all_arrived"), F.count_if(best.isNull()).alias("misses"),
        F.count_if(best.isNotNull() & ~F.col("all")).alias("partial"))


def recovered(labelled: DataFrame, clauses: DataFrame) -> DataFrame:
    """Labelled clauses (file, number) with their text, or the error that the splitter did not give them back."""
    both = labelled.join(clauses.groupBy("file", "number").agg(F.max_by("clause", "index").alias("clause")), ["file", "number"], "left")
    return both.withColumn("error", F.when(F.col("clause").isNull(), "clause not recovered by the splitter"))


def length_profile(clauses: DataFrame, group: str, cap: int = 1200, short: int = 120) -> DataFrame:
    """Clauses per group: number, upper median, longest, those over the cap and those below ``short`` characters."""
    sized = clauses.withColumn("size", F.length("clause"))
    middle = at_ranks(sized, group, "size", {"median": UPPER})
    rest = sized.groupBy(group).agg(F.max("size").alias("longest"), F.count_if(F.col("size") > cap).alias("over_cap"), F.count_if(F.col("size") < short).alias("short"))
    return middle.join(rest, group).select(group, F.col("n").alias("clauses"), "median", "longest", "over_cap", "short")


def verdict_confusion(rows: DataFrame) -> DataFrame:
    """One row over (kind, verdict): reds among prohibited and permissive clauses, easy and hard apart, and all verdicts."""
    red, kind = F.col("verdict") == "red", F.col("kind")
    mild = kind.isin("permissive", "permissive_hard")
    return rows.agg(
        F.count_if(kind == "prohibited").alias("prohibited_total"), F.count_if((kind == "prohibited") & red).alias("prohibited_red"),
        F.count_if(mild).alias("permissive_total"), F.count_if(mild & red).alias("false_reds"), F.count_if((kind == "permissive") & red).alias("false_reds_easy"),
        F.count_if((kind == "permissive_hard") & red).alias("false_reds_hard"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("red", "yellow", "green")),
        F.count_if(red == (kind == "prohibited")).alias("correct"))


def signal_scores(cases: DataFrame) -> DataFrame:
    """Per signal and over all (null): cases, exact answers, those whose evidence arrived, matching behaviour and both kinds of failure.

    ``cases``: signal, expected, answered, warns, should_warn, evidence, text. Evidence has arrived if there is none or the text holds it.
    """
    correct, reached = F.lower("answered") == F.lower("expected"), F.col("evidence").isNull() | F.contains("text", "evidence")
    wide = cases.withColumns({"correct": F.coalesce(correct, F.lit(False)), "reached": F.coalesce(reached, F.lit(False))})
    w, s = F.col("warns"), F.col("should_warn")
    return wide.rollup("signal").agg(
        F.count("*").alias("cases"), F.count_if("correct").alias("exact"), F.count_if("reached").alias("evidence_reached"), F.count_if(F.col("reached") & F.col("correct")).alias("exact_of_those"),
        F.count_if(w == s).alias("behaviour_matches"), F.count_if(s & ~w).alias("missed_mismatches"), F.count_if(w & ~s).alias("false_alarms"),
        F.count_if(w & s & ~F.col("correct")).alias("wrong_but_warned"))


def coverage(swept: DataFrame, register: DataFrame) -> DataFrame:
    """(section, gap): swept candidates that no register entry decides, and register entries that the sweep did not offer."""
    candidates = swept.filter("kind = 'lease_text_required'").select("section").distinct()
    decided = register.select("section").distinct()
    undecided = candidates.join(decided, "section", "left_anti").withColumn("gap", F.lit("undecided"))
    return undecided.unionByName(decided.join(candidates, "section", "left_anti").withColumn("gap", F.lit("not_found")))


def answer_rows(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """Answers (id, section, verdict, cited, retrieved) with cites_gt, retrieval_had_gt and the sections cited outside the corpus."""
    each = answers.select("id", F.explode("cited").alias("cited_section")).distinct()
    strange = each.join(corpus.select(F.col("section").alias("cited_section")).distinct(), "cited_section", "left_anti")
    strange = strange.groupBy("id").agg(F.array_sort(F.collect_list("cited_section")).alias("outside"))
    wide = answers.join(strange, "id", "left").withColumn("outside", F.coalesce("outside", F.array().cast("array<string>")))
    return wide.withColumns({"cites_gt": F.array_contains("cited", F.col("section")), "retrieval_had_gt": F.array_contains("retrieved", F.col("section"))})


def answer_summary(rows: DataFrame) -> DataFrame:
    """Rates of the verdicts, of grounded answers and of those that cite their ground truth; distinct sections cited outside the corpus."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    verdict = F.col("verdict")
    strange = rows.select(F.explode("outside").alias("s")).distinct().agg(F.count("*").alias("sections_outside"))
    main = rows.agg(
        F.count("*").alias("n"), *(rate(verdict == v).alias(v) for v in ("consistent", "contradicts", "declined")),
        F.count_if((verdict == "declined") & F.col("retrieval_had_gt")).alias("declined_despite_retrieval"), rate(~F.col("unsupported")).alias("grounded"),
        rate(F.col("cites_gt")).alias("cites_gt"), F.count_if(F.size("outside") > 0).alias("answers_outside"))
    return main.join(strange, F.lit(True))


def interesting(verdict: Column, unsupported: Column, cites_gt: Column, outside: Column) -> Column:
    """Whether a judge hesitated anywhere on an answer."""
    return (verdict != "consistent") | unsupported | ~cites_gt | (F.size(outside) > 0)


def review_sample(rows: DataFrame, flagged: Column, key: str, size: int, seed: int) -> DataFrame:
    """All flagged rows, then others in the order of a seeded hash up to ``size`` in all; flagged rows may exceed it."""
    marked = rows.withColumn("flagged", flagged)
    hits = marked.filter("flagged")
    rest = marked.filter("not flagged").orderBy(F.xxhash64(F.lit(seed), key), key).limit(max(0, size - hits.count()))
    return hits.unionByName(rest)


def picked_sections(documents: DataFrame, must: list[str], n: int) -> DataFrame:
    """``n`` documents with a section: those of ``must`` in its order, then the longest texts. The last row of a section counts."""
    one = documents.filter("section <> ''").groupBy("section").agg(F.max_by("text", "position").alias("text"), F.min("position").alias("position"))
    place = F.array_position(F.array(*map(F.lit, must)), F.col("section"))
    line = [F.when(place > 0, place).otherwise(len(must) + 1), F.when(place > 0, 0).otherwise(-F.length("text")), "position"]
    return one.orderBy(*line).limit(n)


def carried(results: DataFrame, previous: DataFrame, key: str, paid: list[str]) -> DataFrame:
    """Results with the previous run's paid fields, all or nothing, where a row has none of its own; ``carried`` tells where."""
    old = previous.select(key, *(F.col(c).alias(f"old_{c}") for c in paid))
    both = results.join(old, key, "left")
    bare = F.coalesce(*(F.col(c).cast("string") for c in paid)).isNull()
    had = F.coalesce(*(F.col(f"old_{c}").cast("string") for c in paid)).isNotNull()
    fields = [F.when(bare, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in paid]
    return both.select(*[c for c in results.columns if c not in paid], *fields, (bare & had).alias("carried"))


def compared(rows: DataFrame, config: str, one: str, two: str, value: str) -> DataFrame:
    """Mean and true median of ``value`` under two configurations, side by side, with the ratio of means and of medians."""
    chosen = rows.filter(F.col(config).isin(one, two))
    middle = at_ranks(chosen, config, value, {"low": LOWER, "high": UPPER}).select(config, ((F.col("low") + F.col("high")) / 2).alias("median"))
    both = chosen.groupBy(config).agg(F.avg(value).alias("mean")).join(middle, config)
    side = lambda name, m: F.max(F.when(F.col(config) == name, F.col(m))).alias(f"{name}_{m}")
    per = both.agg(*(side(name, m) for name in (one, two) for m in ("mean", "median")))
    a, b = (lambda m: F.col(f"{one}_{m}")), (lambda m: F.col(f"{two}_{m}"))
    return per.select(
        *(F.round(side(m), 6).alias(f"{name}_{m}") for name, side in (("one", a), ("two", b)) for m in ("mean", "median")),
        F.round(a("mean") / b("mean"), 4).alias("mean_ratio"), F.round(a("median") / b("median"), 4).alias("median_ratio"))


def waves(clauses: Column, seconds: Column, threads: int = 8) -> Column:
    """Time of one document when ``threads`` clauses are judged at a time."""
    return F.ceil(clauses / threads) * seconds


def staircase(rows: DataFrame, running: int, threads: int = 8) -> DataFrame:
    """Documents (id, clauses, seconds per clause) in a queue served ``running`` at a time by id: round, its own time and the wait before it."""
    timed = rows.withColumn("own", waves(F.col("clauses"), F.col("seconds"), threads))
    placed = numbered_rows(timed, ["id"])
    rounds = placed.withColumn("round", F.floor(F.col("place") / running)).groupBy("round").agg(F.count("*").alias("documents"), F.max("own").alias("longest"))
    return rounds
