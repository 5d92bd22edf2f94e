"""Mentions of a name in long texts, in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import _quoted, trim_all
from ledgerloom.operators.quality import first_of

#: Words before a mention by the section that they tell, in order; all words of a line must be there, one of each group.
SECTION_SIGNS = [
    ("schedule_of_investments", [["schedule of investments", "portfolio company"]]),
    ("fair_value_measurements", [["fair value"], ["level", "hierarchy"]]),
    ("commitments", [["unfunded", "commitment"]]),
    ("gains_losses", [["realized", "unrealized"]]),
    ("affiliate_transactions", [["affiliate", "control"]]),
    ("risk_factors", [["risk"]]),
    ("md_and_a", [["management"], ["discussion"]]),
]


def likely_section(before: Column) -> Column:
    """The section that the text before a mention tells, unknown for none (FN-14)."""
    low, out = F.lower(before), F.lit("unknown")
    for name, groups in reversed(SECTION_SIGNS):
        fits = F.lit(True)
        for words in groups:
            fits = fits & low.rlike("|".join(words))
        out = F.when(fits, name).otherwise(out)
    return out


def mentions(docs: DataFrame, target: str, keys: list[str], text: str = "text", around: int = 200, before: int = 500) -> DataFrame:
    """(keys, position from 0, likely_section, snippet) of each mention in any case, in its row (TXT-07, FN-13).

    White space runs count as one space. Of mentions of a document whose snippets begin with the same 80 characters the first
    counts (SET-05).
    """
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    quoted = "(?i)" + _quoted(target)
    found = docs.where(F.lower(flat).contains(target.lower())).withColumn("__flat", flat)
    parts = F.split("__flat", quoted, -1)
    size = len(target)
    starts = F.aggregate(F.transform(parts, F.length), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n + size))
    positions = F.transform(F.slice(starts, F.lit(2), F.size(parts) - 1), lambda p: p - size)
    each = found.select(*keys, "__flat", F.explode(positions).alias("position"))
    begin = F.greatest(F.col("position") - around, F.lit(0))
    snippet = trim_all(F.substring(F.col("__flat"), begin + 1, F.col("position") + size + around - begin))
    broad = F.greatest(F.col("position") - before, F.lit(0))
    out = each.select(*keys, "position", likely_section(F.substring(F.col("__flat"), broad + 1, F.col("position") - broad)).alias("likely_section"), snippet.alias("snippet"))
    return first_of(out.withColumn("__key", F.substring("snippet", 1, 80)), [*keys, "__key"], ["position"]).drop("__key")


def outside_schedule(found: DataFrame) -> DataFrame:
    """The mentions that the schedule does not already hold (FLT-08)."""
    return found.where("likely_section <> 'schedule_of_investments'")
