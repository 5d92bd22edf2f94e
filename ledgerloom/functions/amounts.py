"""Printed amounts as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def clean_amount(raw: Column) -> Column:
    """The amount's digits: no currency sign, no commas, brackets as a minus; '' for null, '' and an em dash (FN-01)."""
    bare = F.trim(F.regexp_replace(raw, "[$,]", ""))
    signed = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(bare, r"^\(|\)$", ""))).otherwise(bare)
    return F.when(raw.isNull() | raw.isin("", DASH), "").otherwise(signed)


def lenient(raw: Column) -> Column:
    """DECIMAL(38,2) of a printed amount; blank or malformed is 0 (FN-11)."""
    return F.coalesce(optional(raw), F.lit(0).cast("decimal(38,2)"))


def optional(raw: Column) -> Column:
    """DECIMAL(38,2) of a printed amount; blank or malformed is null."""
    return F.nullif(clean_amount(raw), F.lit("")).try_cast("decimal(38,2)")


def strict(raw: Column) -> Column:
    """DECIMAL(38,2) of a printed amount; blank is null, malformed raises."""
    return F.nullif(clean_amount(raw), F.lit("")).cast("decimal(38,2)")


def money(value: Column) -> Column:
    """1234567.8 as 1,234,568 (FN-26)."""
    return F.format_number(value, 0)


def signed_money(value: Column) -> Column:
    """As money, with a plus before what is not negative."""
    return F.concat(F.when(value >= 0, "+").otherwise(""), money(value))


def percent(value: Column) -> Column:
    """0.2491 as 24.9%."""
    return F.format_string("%.1f%%", value * 100)
