"""Problem 4: records that fail to parse, set apart with one reason each while the valid rows load.

Records are read permissively under an explicit schema that keeps the raw text of a corrupt one. Corrupt records, and those with a
quotation mark, are then reclassified by quoting and column count, the others by casts. Everything is a built-in expression in one
pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import let

#: The columns of a schedule record and of an issue record, and the values an issue may have.
SCHEDULE_COLUMNS = [
    "company_name", "industry", "investment_category", "investment_type", "rate_spread_floor", "rate_cash_pik", "investment_date",
    "maturity_date", "principal_amount", "cost", "fair_value", "rate_reference", "rate_spread_pct", "rate_floor_pct", "rate_cash_pct",
    "rate_pik_pct", "rate_parsed_by",
]
ISSUE_COLUMNS = ["level", "code", "message", "rows"]
ISSUE_LEVELS = ["error", "warning"]
ISSUE_CODES = [
    "EMPTY_SCHEDULE", "BLANK_COMPANY", "COMPANY_IS_INDUSTRY", "RUNAWAY_COMPANY", "COMPANY_MULTI_CATEGORY", "TOP_COMPANY_CONCENTRATED",
    "BLANK_INDUSTRY", "UNKNOWN_ROWS_PRESENT",
]
NO_VALUE = ["", "-", "--", "—"]
AMOUNT = r"^(?:-?\$?D|\$-D|\(\$?D\)|\$\(D\))$".replace("D", r"[0-9]+(?:,+[0-9]+)*(?:\.[0-9]+)?")
DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
ROWS = r"^(?:0*[1-9][0-9]*(?:;0*[1-9][0-9]*)*)?\z"
#: Fixed value: Unicode white space, with the separators that trimming takes for white space.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))

AMOUNTS, DATES = ["principal_amount", "cost", "fair_value"], ["investment_date", "maturity_date"]


def trimmed(c: Column) -> Column:
    return F.coalesce(F.btrim(c, F.lit(SPACES)), F.lit(""))


def amount(c: Column) -> Column:
    """The amount as DECIMAL(38,6), null for no value."""
    t = trimmed(c)
    bare = F.regexp_replace(t, r"[$,()\-]", "").try_cast("decimal(38,6)")
    return F.when(t.isin(NO_VALUE) | ~t.rlike(AMOUNT), None).when(t.rlike(r"[-(]"), -bare).otherwise(bare)


def beyond(c: Column) -> Column:
    """Whether a valid amount has more digits than DECIMAL(38,6) holds."""
    t = trimmed(c)
    return ~t.isin(NO_VALUE) & t.rlike(AMOUNT) & amount(c).isNull()


def date(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t.rlike(DATE), F.try_to_date(t, "M/d/yyyy"))


def bad_amount(c: Column) -> Column:
    t = trimmed(c)
    return ~(t.isin(NO_VALUE) | t.rlike(AMOUNT))


def bad_date(c: Column) -> Column:
    return ~(trimmed(c).isin(NO_VALUE) | date(c).isNotNull())


def _masked(raw: Column) -> Column:
    """raw with each quoted run as one mark: what is left shows the commas between fields and every stray quote."""
    return F.regexp_replace(F.regexp_replace(raw, "\u0001", " "), '"[^"]*"', "\u0001")


#: Ends a record for the reader: not a line break, which may stand inside a field; a noncharacter, which no text holds.
RECORD_END = "\uffff"
MOST_COLUMNS = 20_480


def _parsed(raw: Column, columns: list[str]) -> Column:
    """The record read permissively: its columns, and its raw text in _corrupt where it does not fit them."""
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, "_corrupt"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "maxColumns": str(MOST_COLUMNS), "lineSep": RECORD_END, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return F.from_csv(F.translate(raw, RECORD_END, "\ufffd"), schema, options)


def _bad_row(r: Column) -> Column:
    return reduce(lambda a, b: a | b, [*(bad_amount(r[c]) for c in AMOUNTS), *(bad_date(r[c]) for c in DATES)])


def _bad_issue(r: Column) -> Column:
    level, code, rows = (F.coalesce(r[c], F.lit("")) for c in ("level", "code", "rows"))
    return ~level.isin(ISSUE_LEVELS) | ~code.isin(ISSUE_CODES) | ~rows.rlike(ROWS)


def classify(records: DataFrame, raw: str = "raw_text", feed: str = "feed") -> DataFrame:
    """records and three columns: row (STRUCT of the schedule's columns, all STRING), issue (STRUCT of an issue's), reason STRING.

    reason is null for a valid record, else the first that applies of broken_quoting, column_count and invalid_value. A null record
    counts as one of no columns. A feed that is neither schedule nor issue, or null, has no column count that fits: column_count. An
    unquoted field may hold line breaks. Columns of records stay as they are, whatever their names, but for row, issue and reason.
    """
    text, kind = F.col(raw), F.col(feed)

    def broken(fields: Column) -> Column:
        return F.exists(fields, lambda f: f.contains('"') | (f.contains("\u0001") & ~f.rlike(r"^\x01+\z")))

    # the reader fails on a record of more columns than it holds, even when it is permissive
    few = let(F.split(_masked(text), ",", -1), lambda f: ~broken(f) & (F.size(f) < MOST_COLUMNS))
    readable = F.when(F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) < MOST_COLUMNS, True).otherwise(few)

    def read(name: str, columns: list[str], bad) -> Column:
        """The record as read, its raw text if it is corrupt, and whether a value is bad; it is read once for all of these."""
        whole = let(_parsed(text, columns), lambda r: F.struct(r.dropFields("_corrupt").alias("values"), r["_corrupt"].alias("corrupt"), bad(r).alias("bad")))
        return F.when((kind == name) & readable, whole)

    out = records.withColumn("__schedule", read("schedule", SCHEDULE_COLUMNS, _bad_row)).withColumn("__issue", read("issue", ISSUE_COLUMNS, _bad_issue))
    corrupt = F.coalesce("__schedule.corrupt", "__issue.corrupt")
    unread = text.isNull() | ~F.coalesce(kind.isin("schedule", "issue"), F.lit(False))

    def why(fields: Column) -> Column:
        wanted = F.when(kind == "schedule", len(SCHEDULE_COLUMNS)).when(kind == "issue", len(ISSUE_COLUMNS)).otherwise(-1)
        # what the reader calls corrupt is never loaded, even where count and quoting seem right
        return F.when(broken(fields), "broken_quoting").when(F.size(fields) != wanted, "column_count").when(corrupt.isNotNull(), "broken_quoting")

    # the reader takes a blank record for one of nulls
    suspect = unread | ~readable | corrupt.isNotNull() | text.contains('"') | (trimmed(text) == "")
    out = out.withColumn("__reason", F.when(text.isNull(), "column_count").when(suspect, let(F.split(_masked(text), ",", -1), why)))
    bad = F.coalesce(F.col("__schedule.bad"), F.col("__issue.bad"), F.lit(False))
    reason = F.coalesce("__reason", F.when(bad, "invalid_value"))
    own = {"row": F.when(reason.isNull(), F.col("__schedule.values")), "issue": F.when(reason.isNull(), F.col("__issue.values")), "reason": reason}
    return out.withColumns(own).drop("__reason", "__schedule", "__issue")


def rejected(records: DataFrame, key: str = "record_id", raw: str = "raw_text", feed: str = "feed") -> DataFrame:
    """(key, reason, raw) of the rejected records."""
    return classify(records, raw, feed).where("reason IS NOT NULL").select(key, "reason", raw)


def schedule_rows(records: DataFrame, key: str = "record_id", raw: str = "raw_text", feed: str = "feed") -> DataFrame:
    """The valid schedule records: key, the 17 columns as printed, amounts as DECIMAL and dates as DATE beside them.

    too_large names the amounts that are valid but have more digits than the DECIMAL holds; their value is null, their text stays.
    """
    good = classify(records, raw, feed).where("reason IS NULL AND row IS NOT NULL")
    typed = [*(amount(F.col("row")[c]).alias(f"{c}_value") for c in AMOUNTS), *(date(F.col("row")[c]).alias(f"{c}_value") for c in DATES)]
    large = F.concat_ws(";", *(F.when(beyond(F.col("row")[c]), c) for c in AMOUNTS)).alias("too_large")
    return good.select(key, *(F.col("row")[c].alias(c) for c in SCHEDULE_COLUMNS), *typed, large)


def issue_rows(records: DataFrame, key: str = "record_id", raw: str = "raw_text", feed: str = "feed") -> DataFrame:
    """The valid issue records: key, level, code, message, rows_text as written and rows as ARRAY<BIGINT>, empty where none are named.

    A row number that a BIGINT does not hold is null in rows; rows_text has it.
    """
    good = classify(records, raw, feed).where("reason IS NULL AND issue IS NOT NULL")
    text = F.coalesce(F.col("issue.rows"), F.lit(""))
    rows = F.transform(F.filter(F.split(text, ";"), lambda n: n != ""), lambda n: n.try_cast("bigint"))
    return good.select(key, F.col("issue.level").alias("level"), F.col("issue.code").alias("code"), F.col("issue.message").alias("message"), text.alias("rows_text"), rows.alias("rows"))
