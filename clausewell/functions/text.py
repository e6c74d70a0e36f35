"""Scalar text functions as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The forms of a citation, a printed clause number and a term.
CITATION = r"^RCW \d+\.\d+\.\d+"
TERM = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
CUT_MARK = "\n\n[…truncated]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Lower-case terms of two characters or more; dotted numbers stay one term. Null text has none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1)


def base_section(citation: Column) -> Column:
    """The section that a citation begins with, else the citation itself."""
    return F.coalesce(F.nullif(F.regexp_extract(citation, CITATION, 0), F.lit("")), citation)


def printed_number(clause: Column) -> Column:
    """The number printed before a clause, or null."""
    return F.nullif(F.regexp_extract(clause, r"^\s*(\d{1,2})[.)]\s", 1), F.lit("")).cast("int")


def preview(clause: Column, size: int = 120) -> Column:
    """One line of a clause, cut at the last blank within ``size`` characters."""
    flat = strip(F.regexp_replace(clause, r"(?U)\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, size), r" [^ ]*$", ""), F.lit(" …"))
    return F.when(F.length(flat) > size, cut).otherwise(flat)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def clamped(text: Column, most: int = 6000) -> Column:
    """A message cut to ``most`` characters, with a mark where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def mismatch(named: Column, applied: Column) -> Column:
    """A named jurisdiction other than the applied one; unknown is never a mismatch."""
    return (F.lower(named) != "unknown") & (F.lower(named) != F.lower(applied))


def logged_source(source: Column, client: Column) -> Column:
    """Uploads are logged by their extension alone, other sources by their base name."""
    suffix = F.lower(F.regexp_extract(source, r"(\.[^./]+)$", 1))
    return F.when(client.isin("ui", "api"), F.concat(F.lit("upload"), suffix)).otherwise(F.regexp_extract(source, r"([^/]*)$", 1))


def chunk_order(chunk_id: Column) -> Column:
    """The number behind the last hyphen of a chunk id, else 0."""
    return F.coalesce(F.substring_index(chunk_id, "-", -1).try_cast("int"), F.lit(0))


#: The named character references that pages use most, for those who compare with an engine that knows no others.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&sect;", "§"), ("&para;", "¶"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&deg;", "°"), ("&middot;", "·"),
    ("&frac12;", "½"), ("&cent;", "¢"), ("&eacute;", "é"), ("&amp;", "&"))
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """Character references by number and by any name that HTML knows, as characters, each once, in batches of texts.

    The names are two thousand, some without a semicolon and matched by their beginnings, which built-in functions took
    several times as long for. Null stays null.
    """
    return F.pandas_udf(_unescaped, StringType())(text)


#: A reference that its semicolon closes, and &amp without one.
CLOSED = re.compile(r"&(?:amp(?!;)|(?:#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);)")


def _closed(texts: pd.Series) -> pd.Series:
    def one(found: re.Match) -> str:
        name = found[0][1:]
        return "&" if name == "amp" else html.unescape(found[0]) if name[0] == "#" or name in html5 else found[0]

    return texts.map(lambda text: CLOSED.sub(one, text), na_action="ignore")


def unescaped_closed(text: Column) -> Column:
    """As ``unescaped``, but a name without its semicolon, as a cut text leaves it, stays as it is, &amp apart."""
    return F.pandas_udf(_closed, StringType())(text)


def page_text(page: Column, references: Callable[[Column], Column] = unescaped) -> Column:
    """Text of a page: block ends become line ends, tags go, blanks collapse, and blank lines are kept singly."""
    text = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?i)</(div|p|h3|tr|table)>|<br[ \t\r\n]*/?>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", "")
    text = F.regexp_replace(references(text), "[ \\t\\u00a0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " ?\\r?\\n ?", "\n"), "\\n{3,}", "\n\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+\\z", "")


#: Footers, wrappers, claims and what negates them.
FOOTER = "\n\n**Statutes cited:**"
SELF_NUMBERED = r"^\s*\d+\s*[.)]"
CLAIMS = (
    r"(?i)no violations|0 red flags|no red flags|nothing (?:is )?(?:wrong|missing|illegal)|fully compliant|entirely compliant|pre-?approved"
    r"|no (?:issues|problems)(?: were)? (?:found|identified)")
NEGATED = r"(?i)(?:not|n't|never|isn't|aren't|rather than|far from)\s+\S{0,15}$"
PROBLEM = r"(?i)illegal|unenforceable|void|prohibit|violat|unlawful|not legal|conflict|not compliant|contrary to|breach"
STATUTE = "https://app.leg.wa.gov/RCW/default.aspx?cite="


def statute_url(citation: Column) -> Column:
    """The address of a citation's section; empty for an empty citation."""
    number = strip(F.regexp_replace(base_section(citation), r"^RCW\s*", ""))
    return F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(F.concat(F.lit(STATUTE), number))


def section_name(stem: Column) -> Column:
    """The citation of a file such as rcw-59-18-060."""
    parts = F.split(stem, "-")
    return F.concat(F.upper(F.get(parts, F.lit(0))), F.lit(" "), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "."))


def leading_number(clause: Column) -> Column:
    """The number before the first full stop when nothing but digits stands there, or null."""
    return F.regexp_extract(strip(clause), r"^(\d{1,9})\.", 1).try_cast("int")


def clause_label(clause: Column, index: Column) -> Column:
    """The clause's place in the scan, or null when the clause prints a number of its own."""
    return F.when(~clause.rlike(SELF_NUMBERED), F.concat(F.lit("Clause "), index.cast("string")))


def clean(text: Column) -> Column:
    """Without control and format characters, blanks collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)[\s]+", " "), r"\p{C}", ""))


def without_footer(text: Column) -> Column:
    """An answer before the footer that the engine adds to it."""
    return F.substring_index(text, FOOTER, 1)


#: A footer of statutes that a model wrote itself, and its imitation of a message's parts.
MODEL_FOOTER = r"\n+(?:-{3,}\n+)?\**Statutes cited(?: in this answer)?:?\**[\s\S]*\z"
PARTS = r"""^\s*\[\s*\{\s*(['"])text\1\s*:\s*(['"])([\s\S]*?)\2\s*(?:,[\s\S]*?)?\}\s*,?\s*\]\s*\z"""


def without_model_footer(text: Column) -> Column:
    """An answer before a list of statutes that the model itself put under it."""
    return F.regexp_replace(text, MODEL_FOOTER, "")


def unwrapped(text: Column) -> Column:
    """The text inside an imitation of ``[{'text': ...}]``, if that is the whole answer, with its escaped line ends and quotes undone."""
    inner = F.replace(F.replace(F.regexp_extract(text, PARTS, 3), F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'"))
    return F.when(text.rlike(PARTS), strip(inner)).otherwise(text)


def needs_retrieval(category: Column) -> Column:
    return F.coalesce(category == "legal_question", F.lit(False))


def message_text(parts: Column) -> Column:
    """The text of a message of parts (type, text): the texts of its text parts, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def adopted_claim(answer: Column) -> Column:
    """The first claim of innocence that no negation stands before within 24 characters, or null."""
    parts, found = F.split(answer, CLAIMS), F.regexp_extract_all(answer, F.lit(CLAIMS), F.lit(0))
    before = F.transform(F.sequence(F.lit(0), F.size(found)), lambda k: F.right(F.concat_ws("", F.get(parts, k - 1), F.get(found, k - 1), F.get(parts, k)), F.lit(24)))
    each = F.zip_with(found, before, lambda claim, left: F.when(claim.isNotNull() & ~left.rlike(NEGATED), claim))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def answer_holds(answer: Column) -> Column:
    """Whether an answer names a problem and adopts no claim of innocence."""
    return adopted_claim(answer).isNull() & answer.rlike(PROBLEM)


def fingerprint(configuration: Column) -> Column:
    """The first twelve digits of the SHA-256 of a configuration."""
    return F.substring(F.sha2(configuration, 256), 1, 12)


def first_mentions(answer: Column) -> Column:
    """The sections that an answer names, in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"RCW \d+\.\d+\.\d+"), F.lit(0)))


def iso_seconds(moment: Column) -> Column:
    """A moment as logs write it, to the second, in the session's time zone; null for null."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
