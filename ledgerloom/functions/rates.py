"""Interest-rate terms from the two rate cells of a schedule row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import trim_all

#: Reference rates by their letter, and cells that hold nothing.
REFERENCES = {"S": "SOFR", "P": "Prime", "L": "LIBOR", "B": "Base Rate"}
NOTHING = ["", "-", "--", "—"]
NUMBER = r"([0-9.]+)"


def _found(cell: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(cell, pattern, group), F.lit(""))


def _number(cell: Column, pattern: str) -> Column:
    return _found(cell, pattern).try_cast("double")


def parse_rate(spread_floor: Column, cash_pik: Column) -> Column:
    """STRUCT<reference, spread_pct, floor_pct, cash_pct, pik_pct, raw, parsed_by> of the two cells (FN-08 to FN-10).

    parsed_by is none where both cells hold nothing, else regex. Numbers that do not parse are null.
    """
    a, b = (F.when(trim_all(c).isin(NOTHING), "").otherwise(trim_all(F.coalesce(c, F.lit("")))) for c in (spread_floor, cash_pik))
    letter = _found(a, r"\(\s*([SPLB])\s*\+\s*[0-9.]+\s*%\s*\)")
    by_letter = F.element_at(F.create_map(*(F.lit(x) for kv in REFERENCES.items() for x in kv)), letter)
    reference = F.when(letter.isNotNull(), by_letter).otherwise(F.upper(_found(a, r"(?i)\b(SOFR|LIBOR|Prime|Base Rate)\b")))
    spread = F.when(letter.isNotNull(), _number(a, rf"\(\s*[SPLB]\s*\+\s*{NUMBER}\s*%\s*\)")).otherwise(_number(a, rf"\+\s*{NUMBER}\s*%"))
    floor = F.coalesce(_number(a, rf"\)\s*/\s*\(\s*{NUMBER}\s*%\s*\)"), _number(a, rf"(?i){NUMBER}\s*%\s*floor"))
    pair = rf"^\s*{NUMBER}\s*%\s*/\s*{NUMBER}\s*%\s*$"
    paired = b.rlike(pair)
    cash_word, pik_word = _number(b, rf"(?i){NUMBER}\s*%\s*cash"), _number(b, rf"(?i){NUMBER}\s*%\s*PIK")
    alone = F.when(cash_word.isNull() & pik_word.isNull(), _number(b, rf"^\s*{NUMBER}\s*%\s*$"))
    none = (a == "") & (b == "")
    raw = F.concat_ws(" | ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    fields = {
        "reference": reference, "spread_pct": spread, "floor_pct": floor,
        "cash_pct": F.when(paired, _number(b, pair)).otherwise(F.coalesce(cash_word, alone)),
        "pik_pct": F.when(paired, _found(b, pair, 2).try_cast("double")).otherwise(pik_word),
        "raw": raw, "parsed_by": F.when(none, "none").otherwise("regex"),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def incomplete(rate: Column) -> Column:
    """Whether neither a floating nor a fixed rate is known (FLT-05)."""
    return ~((rate["reference"].isNotNull() & rate["spread_pct"].isNotNull()) | rate["cash_pct"].isNotNull())


def with_fallback(df: DataFrame, rate: str, fallback: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """df with the rates that stayed incomplete sent through a model hook (FLT-06, UDF-02).

    The hook gets only those rows and returns them with the same columns; without one, df stays as it is.
    """
    if fallback is None:
        return df
    open_ = incomplete(F.col(rate)) & (F.col(rate)["parsed_by"] == "regex")
    return df.where(~open_).unionByName(fallback(df.where(open_)))
