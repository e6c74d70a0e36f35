"""Secret scan: candidates by pattern, false positives removed by random forests; DataFrame functions only.

Candidates are runs of at least 16 key characters, and whatever is assigned after a credential name, of any length and
of any symbols, up to its closing quote or, without quotes, the next blank. What is known of a candidate falls into two
views: its own characters (length, transitions, dictionary coverage, path signs), and the words and signs beside it.
The likelihood of a transition and the dictionary come from the token counts of the whole corpus.

Labelled findings come as a table with the feature columns and ``label``; one forest then learns from all features.
Where there is none, two forests are trained, and each sees only the view that its labels do not come from: the forest
over a candidate's characters learns from findings that their neighbours decide (assigned to a credential name, against
links, other names and bare prose), the forest over its neighbours from findings that their characters decide (a
provider's key format or a random mixture, against words and numbers). So no label is a function of the inputs. A
finding's score is the mean of both. Training uses at most ``most_labelled`` findings per forest, those with the
smallest hash, a documented bound; ``held_out_quality`` measures both forests on candidates they have not seen.

Defined cases: null and empty texts have no candidates; a candidate that repeats is one finding per occurrence;
repeated rows give their findings again; a forest whose labels have one class alone is replaced by its labels' rules,
and findings that no rule decides count as false there; texts are read whole; other columns are never read, and
``redact`` passes them through.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import BLANKS, Scratch

#: What a candidate is made of, and the word lists of the features.
RUN = r"[A-Za-z0-9_+/=\-]{16,}"
NAMES = r"(?i)(token|secret|passw(or)?d|passphrase|passcode|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
#: A credential name and the sign that assigns to it; authors, secretaries and token counts are none.
NAMED = r"(?!(?i:author(?!i[sz])|secretar|tokens\b|tokeni[sz]))" + NAMES + r"[\w-]*[\"']?\s*(?:=>|[:=]=?)\s*"
ASSIGNED = NAMED + r"[\"']?$"
#: A name with what is assigned to it: up to the quote that closes it on its line, or the next blank.
PAIR = r"[\w-]*" + NAMED + r"(?:\"[^\"\r\n]+(?=\")|'[^'\r\n]+(?=')|[\"']?[^\s\"']+)"
HEAD = r"^[\w-]*" + NAMED + r"[\"']?"
FOUND = f"{PAIR}|{RUN}"
#: Lone words, hyphened ones too, in small letters, capitals or with a capital first.
WORDS = r"^(\p{L}?\p{Ll}+|\p{Lu}+)([-_/]+(\p{L}?\p{Ll}+|\p{Lu}+))*[.,;:!?)]*$"
#: Assigned values that prove nothing: words, numbers, sentences, calls and placeholders.
UNSURE = WORDS + r"|^[0-9.,]+$|\s|[(){}<>\[\]]|^\$"
#: A quoted passphrase: three words or more in small letters, none of them from a message about passwords.
PHRASE = r"^(?!.*\b(the|your|not|for|and|with|must|enter|required|invalid|wrong|please|you|has|have|are|was|this|that)\b)\p{Ll}{3,}([ _-]\p{Ll}{3,}){2,}$"
#: Findings of 8 characters or more that hold one of these are redacted wherever they stand in their document.
TELLING = r"[0-9]|[^\p{L}\s._,;:'(){}\[\]/-]"
INNER = r"(?i)^(token|secret|passw(or)?d|pwd|api[_-]?key|auth)[\w-]*[=:]"
PROVIDER = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-|^sk_live_|^AIza[\w-]{35}$"
OTHER_NAMES = r"(?i)(sha|commit|hash|digest|checksum|uuid|guid|isbn|phone|fax|order|invoice|version|build|id|card|iban)[\"']?\s*[:=#]?\s*[\"']?$"
#: A candidate's own characters, and what stands beside it.
VALUE_FEATURES = (
    "length", "distinct", "digit_share", "upper_share", "lower_share", "hex_only", "digit_only", "kind_changes", "vowel_changes", "longest_letters",
    "transitions", "dictionary", "slashes")
NEAR_FEATURES = ("in_link", "has_extension", "key_name_near", "assigned", "quoted", "other_name_near", "prose_near")
FEATURES = VALUE_FEATURES + NEAR_FEATURES
#: Character classes of a transition: the letters, other letters, digits, other signs.
CLASSES = "abcdefghijklmnopqrstuvwxyz*0-"
#: Words of the dictionary, the most frequent ones; they enter the plan as one constant of some 300 KB.
MOST_WORDS = 20_000
SLOTS = 2048


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def _held(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with its columns computed here: a generator keeps later lambdas from computing them once per element."""
    return rows.select(F.explode(F.array(F.struct(*names))).alias("_cw_row")).select("_cw_row.*")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start (in code points), candidate, and 48 characters before and after it, one row per occurrence."""
    some = docs.select("doc_id", "text").filter(F.col("text").rlike(f"{NAMED}|{RUN}"))
    # most texts name no credential and are cut by the plain pattern, which finds the same in them
    pattern = F.when(F.col("text").rlike(NAMED), F.lit(FOUND)).otherwise(F.lit(RUN))
    split = some.select("doc_id", F.split("text", pattern).alias("gaps"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("runs"))
    placed = split.withColumn("lengths", F.zip_with("gaps", "runs", lambda g, r: F.length(g) + F.coalesce(F.length(r), F.lit(0))))
    placed = _held(placed, "doc_id", "gaps", "runs", "lengths")
    # running starts in blocks of about the root of their number, so that a text of very many runs stays cheap
    placed = placed.withColumn("block", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("lengths"))).cast("int")))
    grow = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    zero = F.array(F.lit(0).cast("bigint"))
    parts = F.transform(F.sequence(F.lit(0), F.size("lengths") - 1, F.col("block")), lambda at: F.aggregate(F.slice("lengths", at + 1, F.col("block")), zero, grow))
    placed = _held(placed.withColumn("parts", parts), "doc_id", "gaps", "runs", "parts")
    placed = placed.withColumn("firsts", F.aggregate(F.transform("parts", lambda x: F.element_at(x, -1)), zero, grow))
    placed = _held(placed, "doc_id", "gaps", "runs", "parts", "firsts")
    placed = placed.withColumn("starts", F.flatten(F.transform("parts", lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda at: at + F.get("firsts", k)))))
    each = placed.select("doc_id", F.posexplode(F.arrays_zip(
        F.col("runs").alias("run"), F.col("starts").alias("gap_at"), F.transform("gaps", lambda g: F.length(g)).alias("gap_size"),
        F.transform("gaps", lambda g: F.right(g, F.lit(48))).alias("before"), F.slice(F.transform("gaps", lambda g: F.left(g, F.lit(48))), 2, F.size("gaps")).alias("after"))).alias("k", "z"))
    head = F.regexp_extract("z.run", HEAD, 0)
    named = each.filter("z.run is not null").withColumn("head", F.when(F.length(head) < F.length("z.run"), head).otherwise(""))
    return named.select(
        "doc_id", (F.col("z.gap_at") + F.col("z.gap_size") + F.length("head")).alias("start"), F.substring("z.run", F.length("head") + 1, F.length("z.run")).alias("candidate"),
        F.right(F.concat("z.before", "head"), F.lit(48)).alias("before"), F.coalesce("z.after", F.lit("")).alias("after"))


@dataclass(frozen=True)
class CorpusModel:
    """Mean log-likelihoods of transitions and the dictionary in hashed slots, as constants of the plan."""

    transitions: Column
    dictionary: Column

    def likelihood(self, text: Column) -> Column:
        """Mean log-likelihood of the transitions between the characters of ``text``."""
        codes = F.transform(F.filter(F.split(_classes(text), ""), lambda x: x != ""), lambda x: F.instr(F.lit(CLASSES), x) - 1)
        steps = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.get(self.transitions, a * len(CLASSES) + b))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(steps), F.lit(1))

    def covered(self, text: Column) -> Column:
        """Characters of ``text`` that lie in words of the dictionary."""
        words = F.transform(F.regexp_extract_all(text, F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), F.lit(0)), lambda w: F.lower(w))
        known = F.filter(words, lambda w: F.array_contains(F.get(self.dictionary, F.pmod(F.hash(w), F.lit(SLOTS))), w))
        return F.aggregate(known, F.lit(0), lambda acc, w: acc + F.length(w)).cast("double")


def _classes(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}0-9]", "-"), "[0-9]", "0")
    return F.regexp_replace(plain, r"[^a-z0-]", "*")


def corpus_model(docs: DataFrame, scratch: Scratch) -> CorpusModel:
    """Counts every token of every text; what reaches the driver is a table of fixed size and the first ``MOST_WORDS`` words."""
    tokens = docs.select(F.explode(F.split(F.lower("text"), BLANKS)).alias("token")).groupBy("token").count().filter("length(token) > 1 and length(token) <= 64")
    tokens = scratch.save(tokens, "tokens")
    codes = tokens.select("count", F.transform(F.filter(F.split(_classes(F.col("token")), ""), lambda x: x != ""), lambda x: F.instr(F.lit(CLASSES), x) - 1).alias("codes"))
    steps = codes.select("count", F.explode(F.zip_with(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes))"), lambda a, b: a * len(CLASSES) + b)).alias("step"))
    n = len(CLASSES)
    seen = [[1.0] * n for _ in range(n)]
    for row in steps.groupBy("step").agg(F.sum("count").alias("count")).collect():
        seen[row["step"] // n][row["step"] % n] += row["count"]
    likely = [round(math.log(x / sum(line)), 6) for line in seen for x in line]
    words = tokens.select(F.regexp_replace("token", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"), "count").filter(r"word rlike '^\\p{L}{3,}$'")
    best = words.groupBy("word").agg(F.sum("count").alias("count")).filter("count > 1").orderBy(F.desc("count"), "word").limit(MOST_WORDS)
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for row in best.select("word", F.pmod(F.hash("word"), F.lit(SLOTS)).alias("slot")).collect():
        slots[row["slot"]].append(row["word"])
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    return CorpusModel(constant(likely, "array<double>"), constant(slots, "array<array<string>>"))


def with_features(found: DataFrame, model: CorpusModel) -> DataFrame:
    """Adds one double column per feature of FEATURES, and ``provider_format``, evidence for a label only."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    size = F.length(c).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "1"), "[a-z]+", "a"), "[A-Z]+", "B"), "[_+/=-]+", "-")
    voices = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]+", ""), "[aeiouy]+", "A"), "[b-z]+", "B")
    longest = F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))).cast("double")
    beside = F.concat_ws(" ", before, after)
    return found.withColumns({
        "length": F.log(size), "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "digit_share": _left(c, "[^0-9]+") / size, "upper_share": _left(c, "[^A-Z]+") / size, "lower_share": _left(c, "[^a-z]+") / size,
        "hex_only": flag(c.rlike("^[0-9a-f]+$")), "digit_only": flag(c.rlike("^[0-9]+$")),
        "kind_changes": F.length(kinds) / size, "vowel_changes": F.length(voices) / size, "longest_letters": longest / size,
        "transitions": model.likelihood(c), "dictionary": model.covered(c) / size, "slashes": _left(c, "[^/]+") / size,
        "in_link": flag(before.rlike(r"(https?:|www\.)[^\x20\x09-\x0D]*$")), "has_extension": flag(after.rlike(r"^\.[a-z]{2,5}\b")),
        "key_name_near": flag(before.rlike(NAMES)), "assigned": flag(before.rlike(ASSIGNED)),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")), "other_name_near": flag(before.rlike(OTHER_NAMES)),
        "prose_near": model.covered(beside) / F.greatest(_left(beside, r"[^\p{L}]+"), F.lit(1.0)),
        "provider_format": flag(c.rlike(PROVIDER) | c.rlike(INNER))})


def near_label() -> Column:
    """1.0 or 0.0 where the neighbours of a finding decide, else null. Assigned values that prove nothing stay open."""
    telling = ~F.col("candidate").rlike(UNSURE) | ((F.col("quoted") > 0) & F.col("candidate").rlike(PHRASE))
    alone = (F.col("assigned") + F.col("key_name_near") + F.col("quoted")) == 0
    return F.when((F.col("assigned") > 0) & telling, 1.0).when(((F.col("in_link") + F.col("other_name_near")) > 0) & (F.col("assigned") == 0) | alone, 0.0)


def value_label() -> Column:
    """1.0 or 0.0 where the characters of a finding decide, else null."""
    mixed = (F.col("digit_share") > 0) & (F.col("digit_share") < 0.9) & (F.col("kind_changes") >= 0.25) & (F.col("slashes") == 0) & (F.col("dictionary") == 0) & (F.length("candidate") >= 8)
    plain = (F.col("digit_only") > 0) | F.col("candidate").rlike(WORDS)
    return F.when((F.col("provider_format") > 0) | mixed, 1.0).when(plain, 0.0)


#: (features that the forest sees, labels that it learns, the other view's labels)
VIEWS = ((VALUE_FEATURES, near_label, value_label), (NEAR_FEATURES, value_label, near_label))


def train(labelled: DataFrame, features: tuple = FEATURES, trees: int = 24, depth: int = 6, most_labelled: int = 20_000):
    """A forest over ``features`` fitted to ``label``, or None when a class has no rows."""
    rows = labelled.select("label", *features, F.xxhash64("candidate", "before", "after").alias("_cw_key")).filter("label is not null").orderBy("_cw_key", "label").limit(most_labelled)
    classes = {r["label"] for r in rows.groupBy("label").count().collect()}
    if classes != {0.0, 1.0}:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, labelCol="label", featuresCol="features", subsamplingRate=0.8)
    return forest.fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(rows))


def probability(found: DataFrame, model, features: tuple, name: str) -> DataFrame:
    """Adds ``name``, the forest's probability that a finding is a secret."""
    wide = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(found))
    return wide.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scored(table: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Adds ``score``: by one forest over labelled findings, or the mean of the two forests of VIEWS."""
    if labelled is not None:
        model = train(labelled)
        rules = F.coalesce(near_label(), value_label(), F.lit(0.0))
        return table.withColumn("score", rules) if model is None else probability(table, model, FEATURES, "score")
    out = table
    for k, (features, label, other) in enumerate(VIEWS):
        model = train(table.withColumn("label", label()), features)
        name = f"score_{k}"
        out = out.withColumn(name, F.coalesce(label(), other(), F.lit(0.0))) if model is None else probability(out, model, features, name)
    return out.withColumn("score", (F.col("score_0") + F.col("score_1")) / 2)


def held_out_quality(table: DataFrame) -> DataFrame:
    """Per view: n, precision and recall on the third of the candidates (by hash) that its forest was not trained on."""
    fold = F.pmod(F.xxhash64("candidate"), F.lit(3))
    out = None
    for k, (features, label, _) in enumerate(VIEWS):
        rows = table.withColumn("label", label()).filter("label is not null")
        model = train(rows.filter(fold != 1), features)
        if model is None:
            continue
        held = probability(rows.filter(fold == 1), model, features, "p").withColumn("hit", F.col("p") >= 0.5)
        both = F.count_if(F.col("hit") & (F.col("label") == 1))
        line = held.agg(F.lit(("value", "near")[k]).alias("view"), F.count("*").alias("n"), (both / F.count_if("hit")).alias("precision"), (both / F.count_if(F.col("label") == 1)).alias("recall"))
        out = line if out is None else out.unionByName(line)
    return out


def findings(docs: DataFrame, scratch: Scratch, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """All candidates of ``docs`` with score and verdict. Their features are written once and serve training and scoring."""
    table = scratch.save(with_features(candidates(docs), corpus_model(docs, scratch)), "findings")
    return scored(table, labelled).select("doc_id", "start", "candidate", "score", (F.col("score") >= least).alias("accepted"))


def finding_digests(found: DataFrame) -> DataFrame:
    """Findings without their secrets: place, length, SHA-256, score and verdict."""
    return found.select("doc_id", "start", F.length("candidate").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score", "accepted")


def redact(docs: DataFrame, scratch: Scratch, mark: str = "[secret]", most_broadcast: int = 200_000) -> DataFrame:
    """``docs`` with every accepted finding replaced by ``mark`` and n_chars set to the new length.

    A finding is replaced where it stands. One of 8 characters or more that no word can be is replaced wherever it
    stands in the document; short ones and words could be part of other words there.
    """
    held = findings(docs, scratch).filter("accepted").groupBy("doc_id").agg(F.collect_set(F.struct("start", "candidate")).alias("_cw_found"))
    telling = F.filter("_cw_found", lambda x: (F.length(x["candidate"]) >= 8) & x["candidate"].rlike(TELLING) & ~x["candidate"].rlike(r"\s"))
    held = held.withColumn("_cw_secrets", F.array_distinct(F.transform(telling, lambda x: x["candidate"])))
    held = scratch.save(held.withColumnRenamed("doc_id", "_cw_doc"), "secrets")
    hinted = F.broadcast(held) if held.count() <= most_broadcast else held.hint("shuffle_merge")
    wide = docs.join(hinted, docs["doc_id"].eqNullSafe(F.col("_cw_doc")), "left")
    longest_first = F.array_sort("_cw_secrets", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    # from the last place to the first, so that places still hold; rows under one doc_id may differ, so the text must agree
    at = lambda t, x: F.substring(t, x["start"].cast("int") + 1, F.length(x["candidate"])) == x["candidate"]
    placed = F.aggregate(F.sort_array("_cw_found", False), F.col("text"), lambda t, x: F.when(
        at(t, x), F.overlay(t, F.lit(mark), x["start"].cast("int") + 1, F.length(x["candidate"]))).otherwise(t))
    clean = F.when(F.col("_cw_secrets").isNull(), F.col("text")).otherwise(F.aggregate(longest_first, placed, lambda t, s: F.replace(t, s, F.lit(mark))))
    out = wide.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cw_secrets").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
