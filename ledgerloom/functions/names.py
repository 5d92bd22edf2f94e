"""Company names, investment types and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(c: Column) -> Column:
    """c without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_footnotes(name: Column) -> Column:
    """name without (fka ...) and without markers of one to three small letters; (dba ...) stays (FN-02)."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\s*\(fka\s+[^)]+\)", ""), r"\s*\([a-z]{1,3}\)", "")
    dba = F.regexp_extract(name, r"\(dba\s+[^)]+\)", 0)
    return trim_all(F.when((dba != "") & ~bare.contains("dba"), F.concat_ws(" ", trim_all(bare), dba)).otherwise(bare))


def normalise_type(raw: Column) -> Column:
    """An investment type without unfunded amounts, markers and unit or share counts (FN-03)."""
    t = trim_all(raw)
    for pattern in (r"\s*\(\$[0-9,]+\s*unfunded commitment\)", r"\s*\([a-z]{1,3}\)", r"(?i)\s*\([0-9,.]+\s*(?:LP\s+)?(?:units?|shares?)\)", r"(?i)\s*\(Units?\s+N/A\)"):
        t = F.regexp_replace(t, pattern, "")
    return trim_all(t)


def is_debt(kind: Column) -> Column:
    """Whether an investment type has a principal (FN-06)."""
    return F.lower(kind).rlike("lien|subordinated|mezzanine|revolving")


def slug(c: Column) -> Column:
    """Small letters and digits, all else as single underscores inside (SNK-09)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def highlight(text: Column, target: str) -> Column:
    """text with each occurrence of target, in any case, between >>> and <<< (FN-15)."""
    return F.regexp_replace(text, "(?i)(" + _quoted(target) + ")", ">>> $1 <<<")


def _quoted(target: str) -> str:
    return "\\Q" + target.replace("\\E", "\\E\\\\E\\Q") + "\\E"
