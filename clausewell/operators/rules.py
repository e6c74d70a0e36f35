"""Rules as data: a rule is a list of groups of phrases, and a text keeps it when it holds a phrase of every group.

Tables of rules become one column per rule, or the list of what a labelled document gets wrong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewell.functions.text import leading_number

Rule = tuple[tuple[str, ...], ...]

#: What tells each planted violation in its clause.
VIOLATIONS: dict[str, Rule] = {
    "late_fee_early": (("late",), ("first day", "day one", "1st day", "second day", "2nd day", "day 1", "day 2")),
    "short_entry_notice": (
        ("enter", "entry", "access"),
        ("12 hour", "twelve (12) hour", "twelve hour", "24 hour", "twenty-four (24) hour", "twenty-four hour", "without notice", "without prior notice", "no advance notice")),
    "rent_gag": (("rent",), ("confidential", "not disclose", "not discuss", "nondisclosure", "non-disclosure", "shall not reveal")),
    "class_action_waiver": (("class action", "class-action", "jury"),),
    "electronic_only_rent": (("zelle", "venmo", "portal", "electronic"), ("only", "sole", "exclusive", "no other", "no checks", "no cash")),
    "attorney_fees": (("attorney", "legal fees", "legal costs"),),
    "exculpation": (("not be liable", "not liable", "no liability", "hold harmless", "holds harmless", "held harmless"),),
    "rights_waiver": (("waiv",), ("rights", "remedies", "rcw", "landlord-tenant act")),
}
#: What tells that a document addresses each protection.
PROTECTIONS: dict[str, Rule] = {
    "Deposit withholding terms": (("deposit",), ("withheld", "withhold", "deduct")),
    "Move-in condition checklist": (("checklist", "statement of condition", "condition and cleanliness", "walk-through", "walkthrough", "condition report"),),
    "Deposit location disclosure": (("depository", "bank", "trust account"),),
    "Fire safety information": (("fire",),),
    "Mold information": (("mold",),),
}


def holds(text: Column, rule: Rule) -> Column:
    """Whether a lower-cased text holds a phrase of every group; null holds nothing."""
    one = lambda group: reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in group))
    return F.coalesce(reduce(lambda a, b: a & b, map(one, rule)), F.lit(False))


def matches(rows: DataFrame, text: str, rules: dict[str, Rule]) -> DataFrame:
    """``rows`` with ``rules``, the names of the rules that each text keeps, in the order of the table."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    each = F.array(*(F.when(holds(lowered, rule), name) for name, rule in rules.items()))
    return rows.withColumn("rules", F.filter(each, lambda x: x.isNotNull()))


def _chosen(name: Column, text: Column, rules: dict[str, Rule], default: bool) -> Column:
    found = F.lit(default)
    for rule_name, rule in rules.items():
        found = F.when(name == rule_name, holds(text, rule)).otherwise(found)
    return found


def verified(
    leases: DataFrame, violations: dict[str, Rule] = VIOLATIONS, protections: dict[str, Rule] = PROTECTIONS, marker: str = "payload", beginning: int = 40,
) -> DataFrame:
    """``leases`` with ``problems``, empty for a document whose labels hold.

    Columns: mode, clauses and text of the document; planted (array of violation and number), requested (violation names),
    present and missing (protection names), injection (the planted text, or null). Clauses are known by the number printed
    before them; of equal numbers the last one counts. All is worked out inside the row.
    """
    text, listed = F.lower(F.coalesce("text", F.lit(""))), lambda c: F.coalesce(c, F.array().cast("array<string>"))
    numbered = F.filter(F.transform("clauses", lambda c: F.struct(leading_number(c).alias("number"), F.lower(c).alias("clause"))), lambda x: x["number"].isNotNull())

    def clause(number: Column) -> Column:
        own = F.filter(numbered, lambda x: x["number"] == number)
        return F.get(own, F.size(own) - 1)["clause"]

    names = F.array_sort(F.array_distinct(F.transform("planted", lambda p: p["violation"])))
    asked = F.array_sort(F.array_distinct(listed(F.col("requested"))))
    told = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    wrong_clause = F.transform(
        "planted", lambda p: F.when(clause(p["number"]).isNull(), F.concat(p["violation"], F.lit(": claimed clause "), p["number"].cast("string"), F.lit(" not found by the splitter")))
        .when(~_chosen(p["violation"], clause(p["number"]), violations, True), F.concat(p["violation"], F.lit(": signal phrases missing from clause "), p["number"].cast("string"))))
    absent = F.transform(listed(F.col("present")), lambda n: F.when(~_chosen(n, text, protections, False), F.concat(F.lit("protection not addressed verifiably: "), n)))
    mentioned = F.transform(listed(F.col("missing")), lambda n: F.when(_chosen(n, text, protections, False), F.concat(F.lit("protection must be omitted but was mentioned: "), n)))
    injected = F.col("injection").isNotNull()
    whole = F.array(
        F.when(F.coalesce(F.col("mode") != "numbered", F.lit(True)), "clause numbering not detected by the splitter"),
        F.when(names != asked, F.concat(F.lit("planted "), told(names), F.lit(" is not what was requested: "), told(asked))))
    after = F.array(
        F.when(injected & ~F.contains(text, F.lower(F.left("injection", F.lit(beginning)))), "injection not embedded verbatim"),
        F.when(injected & F.contains(text, F.lit(marker)), f"the word {marker} is left in the text"))
    return leases.withColumn("problems", F.filter(F.concat(whole, wrong_clause, absent, mentioned, after), lambda x: x.isNotNull()))
