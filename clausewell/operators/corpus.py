"""Building a corpus: document metadata, chunk checks, sections of pages as documents, numbered chunks, and the drift guard."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.functions.text import page_text, strip, unescaped
from clausewell.operators.places import numbered_rows

METADATA = ("type", "state", "source", "section", "title", "url")
#: Limits of the chunk check: a text of more than LONE characters needs two chunks, and no chunk may exceed LONGEST.
LONE, LONGEST = 2000, 3000
#: The address and the jurisdiction in the head of a section's document, and the lines that are no caption.
SOURCE, JURISDICTION = "https://app.leg.wa.gov/RCW/default.aspx?cite=", "Washington State (Residential Landlord-Tenant Act)"
NO_CAPTION = ("html", "pdf")


def metadata(documents: DataFrame) -> DataFrame:
    return documents.select(*METADATA)


def as_result(headline: Column, summary: Column, original: Column, plain: bool) -> Column:
    """What a chunk shows: its text alone, or headline, summary and text."""
    return original if plain else F.concat(headline, F.lit("\n\n"), summary, F.lit("\n\n"), original)


def target_count(text: Column, size: int = 400) -> Column:
    """How many chunks a text should have."""
    return F.floor(F.length(text) / size) + 1


def chunk_problems(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``key`` and problem of every document whose chunks are refused: a long text left whole, or a chunk that is too long."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n"), F.max(F.length("content")).alias("longest"))
    both = documents.select(key, F.length("text").alias("size")).join(per, key)
    problem = F.when((F.col("size") > LONE) & (F.col("n") == 1), "not split").when(F.col("longest") > LONGEST, "chunk too long")
    return both.withColumn("problem", problem).filter("problem is not null").select(key, "problem")


def section_title(text: Column, number: Column) -> Column:
    """The first line that is not empty, does not hold the number and is no page button, without its full stops."""
    lines = F.transform(F.split(text, "\n"), strip)
    caption = F.filter(lines, lambda x: (x != "") & ~F.contains(x, number) & ~F.lower(x).isin(*NO_CAPTION))
    return F.coalesce(F.regexp_replace(F.get(caption, F.lit(0)), r"\.+$", ""), F.lit("Untitled"))


def rendered(sections: DataFrame, references: Callable[[Column], Column] = unescaped) -> DataFrame:
    """(section, name, title, content): sections (section, fragment of a page) as corpus documents."""
    text = strip(F.regexp_replace(page_text(F.col("fragment"), references), F.concat(F.lit(r"^(HTML|PDF)*\s*(RCW\s*)?\Q"), "section", F.lit(r"\E\s*")), F.lit("")))
    wide = sections.withColumn("text", text).withColumn("title", section_title(F.col("text"), F.col("section")))
    name = F.concat(F.lit("rcw-"), F.replace("section", F.lit("."), F.lit("-")), F.lit(".md"))
    head = (F.lit("# RCW "), "section", F.lit(" — "), "title", F.lit("\n\nSource: " + SOURCE), "section", F.lit(f"\nJurisdiction: {JURISDICTION}\n\n"))
    content = F.concat(*head, "text", F.lit("\n"))
    return wide.select("section", name.alias("name"), "title", content.alias("content"))


def numbered(chunks: DataFrame, state: str, order: list) -> DataFrame:
    """``chunks`` with chunk_id ``<state>-<n>``, n from 0 in the given order."""
    placed = numbered_rows(chunks, order, "_cw_n")
    return placed.withColumn("chunk_id", F.concat(F.lit(f"{state}-"), F.col("_cw_n").cast("string"))).drop("_cw_n")


def spliced(entries: DataFrame, section: str, units: DataFrame, state: str) -> DataFrame:
    """Entries (position, section, content) with one section's run replaced by ``units`` (unit, content), numbered anew.

    The section must be there and its rows must follow one another; else the result is an error. Bounds and shift are
    three numbers, so rows move without being ordered anywhere.
    """
    own = entries.filter(F.col("section") == section).agg(F.min("position").alias("low"), F.max("position").alias("high"), F.count("*").alias("n")).first()
    if not own["n"] or own["high"] - own["low"] + 1 != own["n"]:
        raise ValueError(f"{section} has no chunks, or they do not follow one another")
    shift = units.count() - own["n"]
    kept = entries.filter(~F.col("section").eqNullSafe(section))
    moved = kept.withColumn("position", F.when(F.col("position") > own["high"], F.col("position") + shift).otherwise(F.col("position")))
    fresh = units.select((F.col("unit") + own["low"]).alias("position"), F.lit(section).alias("section"), "content")
    every = moved.select("position", "section", "content").unionByName(fresh)
    return every.withColumn("chunk_id", F.concat(F.lit(f"{state}-"), F.col("position").cast("string")))


#: A diff keeps one line around what changed, and so many lines in all.
AROUND, MOST_LINES = 1, 24


def _diff(old: str, new: str, name: str) -> str:
    lines = list(difflib.unified_diff(old.splitlines(), new.splitlines(), f"committed/{name}", f"live/{name}", lineterm="", n=AROUND))
    if len(lines) > MOST_LINES:
        lines = [*lines[:MOST_LINES], f"… {len(lines) - MOST_LINES} more diff lines"]
    return "\n".join(lines)


def drift_diffs(live: DataFrame, committed: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, diff, added and removed of every document that both sides hold with different texts.

    Which documents differ is told by the join alone; the line diff is made for these. ``added`` and ``removed`` count the
    diff's lines before it is cut. Null is the empty text.
    """
    old = committed.select(F.col(key).alias("_cw_key"), F.coalesce(text, F.lit("")).alias("old"))
    pairs = live.select(key, F.coalesce(text, F.lit("")).alias("new")).join(old, F.col(key) == F.col("_cw_key")).filter("old <> new").select(key, "old", "new")
    kind = dict(live.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, old, new in zip(frame[key], frame["old"], frame["new"], strict=True):
                lines = [x for x in difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="", n=0)][2:]
                rows.append((name, _diff(old, new, str(name)), sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines)))
            yield pd.DataFrame(rows, columns=[key, "diff", "added", "removed"])

    return pairs.mapInPandas(run, f"{key} {kind}, diff string, added int, removed int")


def drift_allowed(live: DataFrame, committed: DataFrame, least: float = 0.9) -> bool:
    """Whether enough was read to speak of drift; fewer than ``least`` of the committed documents is a failed read."""
    return live.count() >= least * committed.count()
