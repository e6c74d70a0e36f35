"""Splitters and packers: one row to many, as higher-order functions over the whole text of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a numbered clause begins, where a sentence ends, and the line ends of a text.
CLAUSE_START = (
    r"(?U)\n(?=\s*(?:\d{1,3}\.\d{1,2}(?:\.\d{1,2})*\.?\s+[A-Z]|\d{1,3}[.)]\s+[A-Z]"
    r"|(?:ARTICLE|Article|SECTION|Section)\s+(?:\d{1,3}|[IVXL]{1,7})\b))")
SENTENCE_END = r"(?U)(?<=[.;:])\s+"
BLANK_LINE = r"(?U)\n\s*\n"
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
LEAST, MOST = 80, 1200


def _strip(name: str) -> str:
    return f"regexp_replace({name}, r'(?U)^\\s+|\\s+$', '')"


def naive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, ord and content: windows of ``size`` characters that overlap; null and empty texts have none."""
    step = size - overlap
    n = F.expr(f"1 + greatest(0, cast(ceil((length(text) - {size}) / {step}) as int))")
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0)
    places = rows.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("ord"))
    return places.select("doc_id", "ord", F.expr(f"substring(text, ord * {step} + 1, {size})").alias("content"))


def capped(clause: str, most: int = MOST) -> str:
    """SQL for the parts of a clause: sentences packed up to ``most`` characters, and what still overruns cut there."""
    joined = _strip("concat(a.buf, ' ', s)")
    fold = (
        f"aggregate(split({clause}, r'{SENTENCE_END}'), named_struct('done', cast(array() as array<string>), 'buf', ''),"
        f" (a, s) -> if(a.buf = '', named_struct('done', a.done, 'buf', s),"
        f" if(length({joined}) > {most}, named_struct('done', concat(a.done, array(a.buf)), 'buf', s), named_struct('done', a.done, 'buf', {joined}))),"
        f" a -> concat(a.done, filter(transform(sequence(0, greatest(cast(ceil(length(a.buf) / {most}) as int), 1) - 1),"
        f" i -> {_strip(f'substring(a.buf, i * {most} + 1, {most})')}), (x, i) -> x <> '' or (i + 1) * {most} < length(a.buf))))")
    return f"if(length({clause}) <= {most}, array({clause}), {fold})"


def split_clauses(docs: DataFrame) -> DataFrame:
    """doc_id, mode and clauses. Numbered clauses where three or more are found, else paragraphs, else lines, the
    latter two packed until a part has three times the least length. Null and empty texts have no clauses (lines)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = base.withColumn("numbered", F.expr(f"filter(transform(split(t, r'{CLAUSE_START}'), x -> {_strip('x')}), x -> length(x) >= {LEAST})"))
    base = base.withColumn("paragraphs", F.expr(f"filter(transform(split(t, r'{BLANK_LINE}'), x -> {_strip('x')}), x -> x <> '')"))
    base = base.withColumn("mode", F.when(F.size("numbered") >= 3, "numbered").when(F.size("paragraphs") >= 3, "paragraphs").otherwise("lines"))
    lines = F.expr(f"filter(transform(split(t, r'{LINE_END}'), x -> {_strip('x')}), x -> x <> '')")
    base = base.withColumn("parts", F.when(F.col("mode") == "paragraphs", F.col("paragraphs")).otherwise(lines))
    joined = "if(a.buf = '', p, concat(a.buf, '\\n\\n', p))"
    packed = F.expr(
        "aggregate(parts, named_struct('done', cast(array() as array<string>), 'buf', ''), (a, p) ->"
        f" if(length({joined}) >= {3 * LEAST}, named_struct('done', concat(a.done, array({joined})), 'buf', ''), named_struct('done', a.done, 'buf', {joined})),"
        " a -> if(a.buf = '', a.done, concat(a.done, array(a.buf))))")
    base = base.withColumn("whole", F.when(F.col("mode") == "numbered", F.col("numbered")).otherwise(packed))
    return base.select("doc_id", "mode", F.expr(f"flatten(transform(whole, c -> {capped('c')}))").alias("clauses"))


def windows(clauses: Column, most: int = 24_000) -> Column:
    """Clauses packed in order into windows of ``most`` characters, joined by a blank line; no clauses: one empty window."""
    return F.aggregate(
        clauses, F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("buf")),
        lambda a, c: F.when(a["buf"].isNull(), F.struct(a["done"].alias("done"), c.alias("buf")))
        .when(F.length(a["buf"]) + 2 + F.length(c) > most, F.struct(F.concat(a["done"], F.array(a["buf"])).alias("done"), c.alias("buf")))
        .otherwise(F.struct(a["done"].alias("done"), F.concat(a["buf"], F.lit("\n\n"), c).alias("buf"))),
        lambda a: F.concat(a["done"], F.array(F.coalesce(a["buf"], F.lit("")))))


def enumerated_units(docs: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, ord, label, stem and item: the lettered items of numbered subsections whose first line ends in a colon."""
    subs = docs.select("doc_id", F.posexplode(F.split("text", r"(?m)^(?=\(\d{1,2}\)\s)")).alias("sub", "part"))
    stem = r"^\((\d{1,2})\)\s+([^\n]+:)[ \t]*(?:\n|$)"
    subs = subs.filter(F.col("part").rlike(stem)).withColumn("body", F.regexp_replace("part", stem, "\n"))
    items = F.filter(F.split("body", r"\n(?=\([a-z]\)\s)"), lambda x: x.rlike(r"^\([a-z]\)\s"))
    rows = subs.withColumn("items", items).filter(F.size("items") >= least)
    each = rows.select(
        "doc_id", "sub", F.regexp_extract("part", stem, 1).alias("number"), F.trim(F.regexp_extract("part", stem, 2)).alias("stem"), F.posexplode("items").alias("ord", "raw"))
    item = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\([a-z]\)\s+", ""), r"(?U)\s+", " "))
    label = F.concat(F.lit("("), "number", F.lit(")("), F.regexp_extract("raw", r"^\(([a-z])\)", 1), F.lit(")"))
    return each.select("doc_id", "sub", "ord", label.alias("label"), "stem", item.alias("item"))


def page_sections(pages: DataFrame) -> DataFrame:
    """page_id, section and fragment: a page cut before every named section anchor."""
    parts = F.filter(F.split("html", r"(?=<a\s+name='\d+(?:\.\d+)+'\s*>)"), lambda x: x.rlike(r"^<a\s+name='"))
    return pages.select("page_id", F.posexplode(parts).alias("ord", "fragment")).select(
        "page_id", "ord", F.regexp_extract("fragment", r"^<a\s+name='([\d.]+)'", 1).alias("section"), "fragment")
