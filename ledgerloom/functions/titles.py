"""Seniority of job titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a title by tier, and words that make a title one of leadership.
TIERS = [
    (1, ["chief executive officer", "ceo", "president"]),
    (2, ["chief financial officer", "cfo"]),
    (3, ["chief operating officer", "coo"]),
    (4, ["chief technology officer", "cto"]),
    (5, ["chief information officer", "cio"]),
    (6, ["chief information security officer", "ciso"]),
    (7, ["chief marketing officer", "cmo", "chief revenue officer", "cro"]),
    (8, ["chief", "c-level"]),
]
LEADERSHIP = ["chief", "president", "vp", "vice", "director", "manager", "officer", "head", "founder", "ceo", "cfo", "cto", "coo", "general manager", "partner", "executive"]


def rank_title(title: Column) -> Column:
    """1 for the most senior title to 11, 99 for none known; vice presidents come before presidents (FN-12)."""
    t = F.lower(title)
    out = (
        F.when(t.contains("executive vice president") | t.contains("evp"), 9)
        .when(t.contains("senior vice president") | t.contains("svp"), 10)
        .when(t.contains("vice president") | t.contains("vp ") | t.endswith(" vp"), 11)
    )
    for tier, names in TIERS:
        out = out.when(t.rlike("|".join(names)), tier)
    return out.otherwise(99)


def is_leadership(title: Column) -> Column:
    """Whether a title has a word of leadership (FLT-11)."""
    return F.lower(title).rlike("|".join(LEADERSHIP))
