"""Words, prose and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.names import trim_all

SPACES = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it. Expressions inside lambdas are not shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The runs of characters between white space; no word for a null or blank text (FN-16)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def prose_fraction(text: Column) -> Column:
    """The share of words that are letters only and at most 20 of them; 0 without words (AGG-14)."""

    def share(w: Column) -> Column:
        good = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+$") & (F.length(x) <= 20)))
        return F.when(F.size(w) > 0, good / F.size(w)).otherwise(F.lit(0.0))

    return let(words(text), share)


def is_noise(text: Column, least: float = 0.55) -> Column:
    """Whether a text is tags and figures rather than prose (FLT-13)."""
    return prose_fraction(text) < least


def collapse(text: Column) -> Column:
    """text with each run of white space as one space (SRC-08)."""
    return F.regexp_replace(text, SPACES, " ")


def cite(doc_id: Column, item: Column, section: Column, start: Column, end: Column) -> Column:
    """[doc | Item i (section) | chars a-b] (FN-17)."""
    return F.format_string("[%s | Item %s (%s) | chars %d-%d]", doc_id, item, section, start, end)


def query_text(question: str) -> str:
    """A question as an embedding model for retrieval expects it (FN-18)."""
    return f"Represent this sentence for searching relevant passages: {question}"


def preview(text: Column, most: int = 400) -> Column:
    """text on one line, cut with an ellipsis (FN-20, FN-22)."""
    t = F.regexp_replace(trim_all(text), "\n", " ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def item_header(line: Column) -> Column:
    """The item of a header line such as 'Item 1A. Risk Factors.', else null (FLT-14)."""
    t = trim_all(line)
    item = F.nullif(F.regexp_extract(t, r"(?i)^Item\s+([0-9]+[A-Z]?)\b", 1), F.lit(""))
    return F.when(F.length(t) <= 130, F.upper(item))


def item_title(line: Column) -> Column:
    """What follows the item in a header line."""
    return trim_all(F.regexp_extract(trim_all(line), r"(?i)^Item\s+[0-9]+[A-Z]?\b[.․．]?\s*(.*)$", 1))
