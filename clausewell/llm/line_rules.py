"""Line-first quality rules, with DataFrame functions only.

Every line is held against punctuation, navigation and boilerplate rules. Lines that fail are removed, and a document
is rejected when the removed lines held more than ``most_lost`` per cent of its characters in words, or when the
base rules fail (too few words, or too many of them in repeated three-word windows).

Defined cases: null text is the empty text, has no words and fails the base rules; blank lines neither pass nor fail;
a text of any length is read whole; repeated rows give one result each; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.llm.common import BLANKS, own

#: Patterns of the rules, the same for the SQL twin below.
SYMBOLS = "[#*$%&|<>]"
END = r"[.!?…:;\"'”»)\]][\x20\x09-\x0D]*$"
BARS = r"[^|»›·•]"
NOTICE = r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|enable javascript|click here|lorem ipsum|powered by|sign in|log in|skip to content)"


def _dropped(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules remove."""
    chars = _dropped(line, BLANKS)
    n_words = _dropped(F.regexp_replace(line, r"[^\x20\x09-\x0D]+", "w"), BLANKS)
    capitals, letters = _dropped(line, r"[^\p{Lu}]+"), _dropped(line, r"[^\p{L}]+")
    unfinished = ~line.rlike(END)
    bars = _dropped(line, BARS + "+")
    navigation = (bars >= 3) & (bars * 4 >= n_words)
    boilerplate = (_dropped(line, r"[^#*$%&<>{}~^]+") * 10 >= chars) | line.rlike(NOTICE) | ((letters >= 12) & (capitals * 10 >= letters * 6))
    return (chars > 0) & (unfinished | navigation | boilerplate)


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a table with ``words`` and ``n``.

    Hashes of all three-word windows are sorted with their positions in the low bits; equal neighbours are compared
    word by word, so a hash collision is never taken for a repeat. Texts without equal hashes skip the sorting.
    """
    hashed = docs.withColumn("grams", F.expr(
        "if(n < 3, array(), transform(slice(words, 1, greatest(n - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))))"))
    sized = hashed.withColumn("low", F.expr("if(size(array_distinct(grams)) = size(grams), -1, cast(ceil(log2(n + 1)) as int))"))
    order = sized.withColumn("ordered", F.expr(
        "if(low < 0, cast(array() as array<bigint>), sort_array(transform(grams, (h, i) -> shiftleft(shiftright(h, low), low) + i)))")).withColumn(
        "mask", F.expr("shiftleft(1L, greatest(low, 0)) - 1"))
    same = ("shiftright(p, low) = shiftright(get(ordered, {0}), low) and get(words, cast(p & mask as int)) = get(words, cast(get(ordered, {0}) & mask as int))"
            " and get(words, cast(p & mask as int) + 1) = get(words, cast(get(ordered, {0}) & mask as int) + 1)"
            " and get(words, cast(p & mask as int) + 2) = get(words, cast(get(ordered, {0}) & mask as int) + 2)")
    found = order.withColumn("starts", F.expr(
        f"filter(transform(ordered, (p, k) -> if(({same.format('k + 1')}) or (k > 0 and {same.format('k - 1')}), cast(p & mask as int), -1)), x -> x >= 0)"))
    return found.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(starts, x -> array(x, x + 1, x + 2))))) as bigint)"))


def line_first(docs: DataFrame, most_lost: int = 50) -> DataFrame:
    """Counts, verdicts and the cleaned text of every row of ``docs``."""
    base = docs.select("doc_id", own(F.col("text")).alias("t"))
    base = base.withColumn("flat", F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))).withColumn("lines", F.split("t", "\n"))
    base = base.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", BLANKS)))
    counted = _repeat_words(base.withColumn("n", F.size("words")))
    full = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = counted.withColumns({
        "n_words": F.col("n").cast("bigint"),
        "word_chars": _dropped(F.col("t"), BLANKS).cast("bigint"),
        "n_symbols": _dropped(F.col("t"), r"[^#*$%&|<>]+").cast("bigint"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("bigint"),
        "cleaned": F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = 100 * (F.col("word_chars") - _dropped(F.col("cleaned"), BLANKS)) <= most_lost * F.col("word_chars")
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), "cleaned")


def line_verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns, without the cleaned text."""
    return line_first(docs).drop("cleaned")


_BLANK = r"[\x20\x09-\x0D]"
ORACLE = rf"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (select r, doc_id, t, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') as ws from base),
grams as (select r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from words)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as k from grams) where k > 1),
covered as (select r, count(distinct i + d) as n from twice, (values (0), (1), (2)) as o(d) group by r),
lines as (select r, unnest(string_split(t, chr(10))) as l from base),
sized as (select r, l, length(regexp_replace(l, '{_BLANK}+', '', 'g')) as chars,
  length(regexp_replace(regexp_replace(l, '[^\x20\x09-\x0D]+', 'w', 'g'), '{_BLANK}+', '', 'g')) as n_words,
  length(regexp_replace(l, '[^|»›·•]+', '', 'g')) as bars, length(regexp_replace(l, '[^#*$%&<>{{}}~^]+', '', 'g')) as symbols,
  length(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) as capitals, length(regexp_replace(l, '[^\p{{L}}]+', '', 'g')) as letters from lines),
judged as (select *, not regexp_matches(l, '{END.replace("'", "''")}') or (bars >= 3 and bars * 4 >= n_words) or symbols * 10 >= chars
  or regexp_matches(l, '{NOTICE}') or (letters >= 12 and capitals * 10 >= letters * 6) as fails from sized where chars > 0),
by_line as (select r, count(*) - count(distinct l) as dups, sum(if(fails, chars, 0)) as lost from judged group by r),
counted as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g')) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(dups, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(lost, 0) as lost
  from words left join covered using (r) left join by_line using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= 50 * word_chars as kept from counted
"""
