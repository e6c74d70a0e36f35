"""Registered queries of records without a schema, rules as data and reviews, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.functions import text as T
from clausewell.operators import corpus, evaluation, rules, splitting, studies, variants
from clausewell.operators.places import numbered_rows
from clausewell.sources.tables import append_lines, read_lines, shared_folder, table
from clausewell.study_queries import _TURNS, turns

#: What turns say of leases, by the length of a turn.
PHRASES = (
    "late on the first day", "may enter without notice", "rent stays confidential", "no jury", "portal only", "attorney paid", "not liable", "waives all rights",
    "deposit withheld", "checklist", "held at a bank", "fire and mold")
VIOLATION_NAMES, PROTECTION_NAMES = list(rules.VIOLATIONS), list(rules.PROTECTIONS)


def _mixed_props(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as a number, an object around it, null, nothing, text or broken text."""
    k, u = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    text = (
        F.when(u == 0, F.col("props")).when(u == 1, F.concat(F.lit('{"k": {"n": '), k, F.lit(', "unit": "s"}}'))).when(u == 2, F.lit('{"k": null, "cache_hit": true}'))
        .when(u == 3, F.lit('{"other": [1, 2]}')).when(u == 4, F.concat(F.lit('{"k": "'), k, F.lit('x", "cache_hit": false}'))).otherwise(F.concat(F.lit('{"k": '), k)))
    return variants.parsed(table(spark, d, "events").select("event_id", "event_type", text.alias("props")), "props")


def variant_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = _mixed_props(spark, d)
    return found.select("event_id", variants.kind(F.col("record"), "$.k").alias("kind"), variants.number(F.col("record"), "$.k", "n").alias("k"), "record_broken")


def variant_profile(spark: SparkSession, d: str) -> DataFrame:
    return variants.field_profile(_mixed_props(spark, d), "record", ["$.k", "$.cache_hit", "$.other"], "event_type")


def _leases(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as leases: a turn is a clause that says what its length tells; labels are planted from the same lengths, some wrongly."""
    said = F.get(F.array(*map(F.lit, PHRASES)), (F.col("size") % len(PHRASES)).cast("int"))
    names = lambda c: F.get(F.array(*map(F.lit, c)), (F.col("size") % len(c)).cast("int"))
    each = turns(spark, d).withColumn("clause", F.concat(F.col("index").cast("string"), F.lit(". The tenant: "), said))
    planted = F.when(F.col("size") % len(PHRASES) < 8, F.struct(F.get(F.array(*map(F.lit, VIOLATION_NAMES)), ((F.col("size") + F.when(F.col("size") % 5 == 0, 1).otherwise(0)) % len(PHRASES) % 8).cast("int")).alias("violation"), (F.col("index") + F.when(F.col("size") % 7 == 0, 100).otherwise(0)).alias("number")))
    rows = each.groupBy("file").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("index", "clause"))), lambda x: x["clause"]).alias("clauses"), F.sort_array(F.collect_set(planted)).alias("planted"),
        F.sort_array(F.collect_set(names(PROTECTION_NAMES))).alias("present"), F.max("size").alias("size"))
    violations = F.transform("planted", lambda p: p["violation"])
    return rows.select(
        "file", "clauses", "planted", F.array_join("clauses", "\n").alias("text"), F.when(F.size("clauses") >= 3, "numbered").otherwise("lines").alias("mode"),
        F.when(F.col("file") % 4 == 0, F.array_append(violations, F.lit("rent_gag"))).otherwise(violations).alias("requested"), "present",
        F.filter(F.array(*map(F.lit, PROTECTION_NAMES)), lambda n: ~F.array_contains("present", n)).alias("missing"), F.when(F.col("file") % 6 == 0, names(PHRASES)).alias("injection"))


def verified_leases(spark: SparkSession, d: str) -> DataFrame:
    found = rules.verified(_leases(spark, d))
    return found.select("file", F.size("problems").alias("n_problems"), F.array_join("problems", "; ").alias("problems"))


def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which rules the clauses of these leases keep."""
    each = _leases(spark, d).select("file", F.posexplode("clauses").alias("place", "clause"))
    return rules.matches(each, "clause", rules.VIOLATIONS | rules.PROTECTIONS).select("file", "place", F.array_join("rules", ",").alias("rules"))


def drift_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents against themselves with a first line more and, for every third, the blanks of the last line collapsed."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    live = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("a new line\n"), "text")))
    found = corpus.drift_diffs(live, docs, "doc_id")
    return found.select("doc_id", F.element_at(F.split("diff", "\n"), 4).alias("first_change"), "added", "removed")


def ordered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as judged answers in the order of a report, numbered."""
    rows = turns(spark, d).select("file", "index", "section", F.when(F.col("size") % 4 == 0, "inconsistent").when(F.col("size") % 4 == 1, None).otherwise("consistent").alias("verdict"))
    return numbered_rows(rows, [*evaluation.answer_order(), "file", "index"]).select("file", "index", "place")


def reviewed_cases(spark: SparkSession, d: str) -> DataFrame:
    """Turns review the document that has the number of their length; what was kept of both sides is counted."""
    reviews = turns(spark, d).select("file", "index", F.col("size").alias("question"), (F.col("size") % 3 == 0).alias("agreed"))
    cases = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 500).cast("int").alias("question"), "source")
    kept, dropped = evaluation.partitioned(evaluation.reviewed(reviews, cases), F.col("agreed"))
    both = kept.withColumn("side", F.lit("kept")).unionByName(dropped.withColumn("side", F.lit("dropped")))
    return both.groupBy("source", "side").agg(F.count("*").alias("n"), F.sum("case_id").alias("cases"))


def answer_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are the answers of a user, what came before is retrieval."""
    return evaluation.stage_costs(table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint")), "user_id", "event_type", "tokens", "purchase")


def claimed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Answers as models wrap them: footers go, imitated parts are undone."""
    wrapped = F.when(F.col("index") % 2 == 0, F.concat(F.lit("[{'text': 'See "), "section", F.lit("', 'type': 'text'}]"))).otherwise(F.concat(F.lit("See "), "section", F.lit("\n\n**Statutes cited in this answer:**\n- "), "section"))
    return turns(spark, d).select("file", "index", T.without_model_footer(T.unwrapped(wrapped)).alias("answer"), T.needs_retrieval(F.when(F.col("size") % 2 == 0, "legal_question").otherwise("chat")).alias("retrieves"))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pages between two anchors, cut before each."""
    k = F.col("page_id").cast("string")
    page = F.concat(F.lit("head<a name='59.18."), k, F.lit("'>"), F.coalesce("html", F.lit("")), F.lit("<a  name='59.18."), k, F.lit(".2' ></a><p>tail</p>"))
    found = splitting.page_sections(table(spark, d, "pages").select("page_id", page.alias("html")))
    return found.select("page_id", "ord", "section", F.length("fragment").alias("size"), F.md5("fragment").alias("digest"))


def enumerated_units(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text dealt to four or five lettered items of a subsection; a subsection of three is left alone."""
    piece = lambda k: F.translate(F.substring("text", k * 400 + 1, 400), "\n()", "   ")
    items = [F.concat(F.lit(f"\n({letter}) x "), piece(k)) for k, letter in enumerate("abcde")]
    text = F.concat(F.lit("(1) The landlord shall:"), *items[:4], F.when(F.col("doc_id") % 2 == 0, items[4]).otherwise(""), F.lit("\n(2) The tenant shall:\n(a) pay\n(b) leave\n(c) clean"))
    found = splitting.enumerated_units(table(spark, d, "documents").filter("text is not null").select("doc_id", text.alias("text")))
    return found.select("doc_id", "ord", "label", "stem", F.md5("item").alias("digest"))


def filled_sample(spark: SparkSession, d: str) -> DataFrame:
    """Long documents are flagged and all taken; a seeded choice of others fills the sample up to a third of the table."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("size"))
    found = studies.review_sample(docs, F.coalesce(F.col("size") > 6000, F.lit(False)), "doc_id", docs.count() // 3, 7)
    return found.groupBy("flagged").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def chunk_results(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks with a headline, shown plainly or whole, and their metadata."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("type"), F.col("lang").alias("state"), "source", F.concat(F.lit("S"), "doc_id").alias("section"), F.lit("t").alias("title"), F.lit("").alias("url"), "text")
    shown, plain = (corpus.as_result(F.col("section"), F.col("type"), F.col("text"), alone) for alone in (False, True))
    both = docs.select("doc_id", F.md5(shown).alias("whole"), F.md5(plain).alias("plain"))
    return both.join(corpus.metadata(docs).select(F.substring("section", 2, 20).cast("bigint").alias("doc_id"), "state", "type"), "doc_id")


def logged_days(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines, written in two appends and read back with a schema that knows a field more, by day."""
    log = table(spark, d, "events").select("event_id", T.iso_seconds(F.col("ts").cast("timestamp")).alias("ts"), "value")
    path = shared_folder(spark, "log")
    append_lines(log.filter("event_id % 2 = 0"), path)
    append_lines(log.filter("event_id % 2 = 1").drop("value"), path)
    rows = read_lines(spark, path, "event_id bigint, ts timestamp, value double, client string")
    return rows.groupBy(T.day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.max(T.iso_seconds(F.col("ts"))).alias("last"), F.count("client").alias("clients"))


NAMES = (logged_days, page_sections, enumerated_units, filled_sample, chunk_results, variant_numbers, variant_profile, verified_leases, rule_matches, drift_diffs, ordered_answers, reviewed_cases, answer_tokens, claimed_sections)
QUERIES = {f.__name__: f for f in NAMES}

_MIXED = """m as (select event_id, event_type, event_id % 6 as u, regexp_extract(props, '[0-9]+') as k from events),
f as (select *, case u when 0 then 'number' when 1 then 'object' when 2 then 'null' when 3 then 'absent' when 4 then 'string' end as kind from m)"""
_SQL = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_P, _V, _N = len(PHRASES), _SQL(VIOLATION_NAMES), _SQL(PROTECTION_NAMES)
_RULE = lambda text, rule: "(" + " and ".join("(" + " or ".join(f"contains({text}, '{p}')" for p in group) + ")" for group in rule) + ")"
_WHICH = lambda name, text, table, default: "case " + name + "".join(f" when '{n}' then {_RULE(text, r)}" for n, r in table.items()) + f" else {default} end"
_LEASES = f"""{_TURNS}, e as (select file, index, size, index || '. The tenant: ' || {_SQL(PHRASES)}[size % {_P} + 1] as said,
    if(size % {_P} < 8, {{'violation': {_V}[(size + if(size % 5 = 0, 1, 0)) % {_P} % 8 + 1], 'number': index + if(size % 7 = 0, 100, 0)}}, null) as p from t),
  l as (select file, list(said order by index, said) as clauses, list_sort(coalesce(list(distinct p) filter (p is not null), [])) as planted, list_sort(list(distinct {_N}[size % 5 + 1])) as present, max(size) as size from e group by file),
  z as (select *, lower(array_to_string(clauses, chr(10))) as text, list_transform(planted, lambda p: p.violation) as names, list_filter({_N}, lambda n: not list_contains(present, n)) as missing,
    if(file % 6 = 0, {_SQL(PHRASES)}[size % {_P} + 1], null) as injection from l)"""
ORACLES = {
    "variant_numbers": f"with {_MIXED} select event_id, kind, if(u in (0, 1), k::double, null) as k, u = 5 as record_broken from f",
    "variant_profile": f"""with {_MIXED} select event_type, 'k' as field, kind, count(*) as n from f where u < 5 group by all
        union all select event_type, 'cache_hit', if(u in (2, 4), 'boolean', 'absent') as kind, count(*) from f where u < 5 group by all
        union all select event_type, 'other', if(u = 3, 'array', 'absent') as kind, count(*) from f where u < 5 group by all""",
    "verified_leases": f"""with {_LEASES}, a as (select *, list_sort(list_distinct(names)) as ns, list_sort(list_distinct(if(file % 4 = 0, list_append(names, 'rent_gag'), names))) as asked from z),
        c as (select file, unnest(planted) as p, generate_subscripts(planted, 1) as place, clauses from a),
        d as (select file, place, p, lower(list_filter(clauses, lambda x: regexp_extract(x, '^(\\d+)\\.', 1) = p.number::varchar)[-1]) as c from c),
        x as (select file, list(if(c is null, p.violation || ': claimed clause ' || p.number || ' not found by the splitter', if({_WHICH('p.violation', 'c', rules.VIOLATIONS, 'true')}, null, p.violation || ': signal phrases missing from clause ' || p.number)) order by place) as wrong from d group by file),
        y as (select file, list_filter([if(len(clauses) < 3, 'clause numbering not detected by the splitter', null), if(ns <> asked, 'planted [' || coalesce(array_to_string(ns, ', '), '') || '] is not what was requested: [' || array_to_string(asked, ', ') || ']', null)]
            || coalesce(wrong, []) || list_transform(present, lambda n: if({_WHICH('n', 'text', rules.PROTECTIONS, 'false')}, null, 'protection not addressed verifiably: ' || n))
            || list_transform(missing, lambda n: if({_WHICH('n', 'text', rules.PROTECTIONS, 'false')}, 'protection must be omitted but was mentioned: ' || n, null))
            || [if(injection is not null and not contains(text, injection[1:40]), 'injection not embedded verbatim', null), if(injection is not null and contains(text, 'payload'), 'the word payload is left in the text', null)], lambda q: q is not null) as problems from a left join x using (file))
        select file, len(problems) as n_problems, coalesce(array_to_string(problems, '; '), '') as problems from y""",
    "rule_matches": f"""with {_LEASES}, c as (select file, generate_subscripts(clauses, 1) - 1 as place, lower(unnest(clauses)) as c from z)
        select file, place, coalesce(array_to_string(list_filter([{", ".join(f"if({_RULE('c', r)}, '{n}', null)" for n, r in (rules.VIOLATIONS | rules.PROTECTIONS).items())}], lambda q: q is not null), ','), '') as rules from c""",
    "drift_diffs": "select doc_id, '+a new line' as first_change, 1 as added, 0 as removed from documents semi join labels using (doc_id) where doc_id % 3 <> 0 and text is not null",
    "ordered_answers": f"with {_TURNS} select file, index, row_number() over (order by if(size % 4 in (2, 3), 1, 0), section nulls first, file, index) - 1 as place from t",
    "reviewed_cases": f"""with {_TURNS}, c as (select doc_id % 500 as size, min(doc_id) as case_id, arg_min(source, doc_id) as source from documents group by 1)
        select source, if(size % 3 = 0, 'kept', 'dropped') as side, count(*) as n, sum(case_id) as cases from t join c using (size) group by all""",
    "answer_tokens": """with e as (select user_id, event_type, regexp_extract(props, '[0-9]+')::bigint as k from events)
        select user_id, sum(k) as total, coalesce(sum(k) filter (event_type <> 'purchase'), 0) as before, coalesce(sum(k) filter (event_type = 'purchase'), 0) as own from e group by user_id""",
    "claimed_sections": f"with {_TURNS} select file, index, 'See ' || section as answer, size % 2 = 0 as retrieves from t",
    "logged_days": """select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(value) filter (event_id % 2 = 0) as valued, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) as last, 0 as clients from events group by 1""",
    "page_sections": """with a as (select page_id, '<a name=' || chr(39) || '59.18.' || page_id || chr(39) || '>' || coalesce(html, '') as a, '<a  name=' || chr(39) || '59.18.' || page_id || '.2' || chr(39) || ' ></a><p>tail</p>' as b from pages)
        select page_id, 0 as ord, '59.18.' || page_id as section, length(a) as size, md5(a) as digest from a union all select page_id, 1, '59.18.' || page_id || '.2', length(b), md5(b) from a""",
    "enumerated_units": """with i as (select doc_id, unnest(range(if(doc_id % 2 = 0, 5, 4))) as k, text from documents where text is not null)
        select doc_id, k as ord, '(1)(' || chr(97 + k::int) || ')' as label, 'The landlord shall:' as stem, md5(trim(regexp_replace('x ' || translate(substring(text, k * 400 + 1, 400), chr(10) || '()', '   '), '\\s+', ' ', 'g'))) as digest from i""",
    "filled_sample": """with n as (select count(*) // 3 as third, count_if(length(text) > 6000) as long, count(*) as every from documents)
        select true as flagged, long as n, long as documents from n where long > 0 union all select false, greatest(0, third - long), greatest(0, third - long) from n where third > long""",
    "chunk_results": """select doc_id, md5('S' || doc_id || chr(10) || chr(10) || source || chr(10) || chr(10) || text) as whole, md5(text) as plain, lang as state, source as type from documents""",
}
