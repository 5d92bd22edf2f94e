"""Rows of schedule tables, as arrays of cell texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import DASH, clean_amount
from ledgerloom.functions.names import is_debt, normalise_type, trim_all

#: Labels of the sections, the longest first, and words that open an investment row.
SECTIONS = [
    ("non-control/non-affiliate investments", "Non-control/Non-affiliate"),
    ("affiliate investments", "Affiliate"),
    ("control investments", "Control"),
]
KINDS = "First Lien|Second Lien|Subordinated|Mezzanine|Preferred Equity|Common Equity|Warrant|Revolving Loan"
DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
RATE = r"[0-9]+\.[0-9]+%\s*/\s*[0-9]+\.[0-9]+%"
SPREAD = r"\([SP]\+"
AMOUNT = r"^[0-9,]+$"
OPEN_AMOUNT = r"^\([0-9,]+$"


def filled(cells: Column) -> Column:
    """The trimmed cells that are more than a sign."""
    return F.filter(F.transform(cells, trim_all), lambda c: ~c.isin("", "$", "%"))


def section_label(first: Column) -> Column:
    """The category that a section row opens."""
    low, out = F.lower(first), F.lit(None).cast("string")
    for label, name in reversed(SECTIONS):
        out = F.when(low.contains(label), name).otherwise(out)
    return out


def classify_row(cells: Column) -> Column:
    """EMPTY, HEADER, SECTION, TOTAL, INVEST, COMPANY, SUBTOTAL or UNKNOWN: the first rule that fits (FLT-03)."""
    ne, first = filled(cells), trim_all(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    low, joined = F.lower(first), F.lower(F.array_join(ne, " "))

    def numeric(c: Column) -> Column:
        return c.rlike(AMOUNT) | c.rlike(OPEN_AMOUNT)

    second = F.coalesce(F.get(ne, F.lit(1)), F.lit(""))
    plain_second = ~(second.rlike(DATE) | second.rlike(RATE) | second.rlike(AMOUNT))
    company = (first != "") & (F.size(F.filter(ne, lambda c: F.regexp_replace(c, "[,$]", "").rlike(AMOUNT))) <= 1) & (F.size(ne) <= 3) & (((F.size(ne) >= 2) & plain_second) | ((F.size(ne) == 1) & ~F.replace(first, F.lit(","), F.lit("")).rlike(AMOUNT)))
    return (
        F.when(F.size(ne) == 0, "EMPTY")
        .when(joined.contains("portfolio company") & joined.contains("investment type"), "HEADER")
        .when(section_label(first).isNotNull() & ~low.contains("total"), "SECTION")
        .when(low.startswith("total"), "TOTAL")
        .when(first.rlike(f"(?i)({KINDS})"), "INVEST")
        .when(company, "COMPANY")
        .when((first == "") & F.exists(ne, numeric), "SUBTOTAL")
        .otherwise("UNKNOWN")
    )


def merged_amounts(cells: Column) -> Column:
    """The amounts of the cells in order; a bracket split over two cells is one negative amount, a dash an empty one (WIN-10).

    An open bracket is closed by the next cell that says anything, and lost at the end of the row.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("open"), empty.alias("out"))

    def step(acc: Column, cell: Column) -> Column:
        c = trim_all(cell)
        skip, opens, closes = c.isin("", "$", "%"), c.rlike(OPEN_AMOUNT), c == ")"
        own = ~c.rlike(SPREAD) & ~c.rlike(RATE) & (c.rlike(AMOUNT) | (c == DASH)) & ~c.rlike(DATE)
        flushed = F.when(acc["open"].isNotNull(), F.array_append(acc["out"], clean_amount(F.concat(acc["open"], F.lit(")"))))).otherwise(acc["out"])
        said = F.when(own, F.array_append(flushed, clean_amount(c))).otherwise(flushed)
        out = F.when(skip, acc["out"]).when(opens, acc["out"]).when(closes & acc["open"].isNotNull(), flushed).otherwise(said)
        open_ = F.when(skip, acc["open"]).when(opens, c).otherwise(F.lit(None).cast("string"))
        return F.struct(open_.alias("open"), out.alias("out"))

    return F.aggregate(cells, start, step, lambda acc: acc["out"])


def extract_fields(cells: Column) -> Column:
    """The eight fields of an investment row as a STRUCT of STRING, '' where there is none (FN-04, FN-05, FN-07)."""
    rest = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), trim_all)
    kind = normalise_type(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    spreads = F.filter(rest, lambda c: c.rlike(SPREAD))
    rates = F.filter(rest, lambda c: c.rlike(RATE) & ~c.rlike(SPREAD))
    dates = F.filter(rest, lambda c: c.rlike(DATE))
    amounts = merged_amounts(rest)
    n, debt = F.size(amounts), is_debt(kind)

    def at(array: Column, i: int) -> Column:
        return F.coalesce(F.get(array, F.lit(i)), F.lit(""))

    def last(array: Column) -> Column:
        return F.coalesce(F.get(array, F.size(array) - 1), F.lit(""))

    fields = {
        "investment_type": kind,
        "rate_spread_floor": last(spreads),
        "rate_cash_pik": last(rates),
        "investment_date": at(dates, 0),
        "maturity_date": at(dates, 1),
        "principal_amount": F.when(debt, at(amounts, 0)).otherwise(""),
        "cost": F.when(debt, at(amounts, 1)).otherwise(at(amounts, 0)),
        "fair_value": F.when(debt, F.when(n >= 3, at(amounts, 2)).otherwise("")).otherwise(at(amounts, 1)),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))
