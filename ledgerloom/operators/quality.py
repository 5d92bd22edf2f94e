"""Rules over schedules: each finds issues of one code, a report holds them in rule order.

Every rule works on all documents at once, keyed by keys. Row numbers are those of the rows that the rule names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import lenient
from ledgerloom.functions.names import trim_all

MAX_ROWS_PER_COMPANY = 50
MAX_TOP_COMPANY_SHARE = 0.40
#: The rules in order.
RULES = [
    ("EMPTY_SCHEDULE", "error"), ("BLANK_COMPANY", "error"), ("COMPANY_IS_INDUSTRY", "error"), ("RUNAWAY_COMPANY", "error"),
    ("COMPANY_MULTI_CATEGORY", "warning"), ("TOP_COMPANY_CONCENTRATED", "warning"), ("BLANK_INDUSTRY", "warning"), ("UNKNOWN_ROWS_PRESENT", "warning"),
]


def _clean(column: str):
    return trim_all(F.coalesce(F.col(column), F.lit("")))


def _row_list(order: str):
    return F.array_sort(F.collect_list(F.col(order).cast("int")))


def empty_schedules(documents: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Documents without any row; the other rules have nothing to say on them (VAL-0)."""
    none = documents.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti")
    return none.select(*keys, F.lit("No investment rows.").alias("message"), F.array().cast("array<int>").alias("rows"))


def blank_companies(rows: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """VAL-1."""
    found = rows.where(_clean("company_name") == "").groupBy(*keys).agg(_row_list(order).alias("rows"))
    return found.select(*keys, F.format_string("%d rows have an empty company_name.", F.size("rows")).alias("message"), "rows")


def companies_that_are_industries(rows: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """Rows whose company is the name of an industry of the same document (VAL-2, JN-03), with five names at most in the message."""
    named = rows.select(*keys, F.col(order).alias("__row"), _clean("company_name").alias("name")).where("name <> ''")
    industries = rows.select(*keys, _clean("industry").alias("name")).where("name <> ''").distinct()
    found = named.join(industries, [*keys, "name"], "left_semi").groupBy(*keys).agg(_row_list("__row").alias("rows"), F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("names"))
    return found.select(*keys, F.format_string("%d rows have an industry as company_name: %s.", F.size("rows"), F.array_join("names", ", ")).alias("message"), "rows")


def runaway_companies(rows: DataFrame, keys: list[str], most: int = MAX_ROWS_PER_COMPANY) -> DataFrame:
    """VAL-3, AGG-07: companies of more than most rows; the three largest in the message (TOP-07)."""
    counts = rows.select(*keys, _clean("company_name").alias("name")).where("name <> ''").groupBy(*keys, "name").agg(F.count("*").alias("n")).where(F.col("n") > most)
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))), 1, 3)
    found = counts.groupBy(*keys).agg(F.count("*").cast("int").alias("companies"), listed.alias("worst"))
    worst = F.array_join(F.transform("worst", lambda x: F.format_string("%s (%d)", x["name"], -x["n"])), ", ")
    return found.select(*keys, F.format_string("%d companies have more than %d rows: %s.", "companies", F.lit(most), worst).alias("message"), F.array().cast("array<int>").alias("rows"))


def companies_of_many_categories(rows: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-4, AGG-08."""
    named = rows.select(*keys, _clean("company_name").alias("name"), _clean("investment_category").alias("category")).where("name <> '' AND category <> ''")
    many = named.groupBy(*keys, "name").agg(F.count_distinct("category").alias("n")).where("n > 1")
    found = many.groupBy(*keys).agg(F.count("*").cast("int").alias("companies"), F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("names"))
    return found.select(*keys, F.format_string("%d companies span categories: %s.", "companies", F.array_join("names", ", ")).alias("message"), F.array().cast("array<int>").alias("rows"))


def concentrated(rows: DataFrame, keys: list[str], most: float = MAX_TOP_COMPANY_SHARE, order: str = "row_no") -> DataFrame:
    """VAL-5, AGG-09: the largest company holds more than most of a positive fair value; of equal ones the first seen counts."""
    sums = rows.select(*keys, _clean("company_name").alias("name"), lenient(F.col("fair_value")).alias("v"), F.col(order).alias("__row")).where("name <> ''").groupBy(*keys, "name").agg(F.sum("v").alias("v"), F.min("__row").alias("__row"))
    best = sums.groupBy(*keys).agg(F.sum("v").alias("total"), F.max_by("name", F.struct("v", -F.col("__row"))).alias("name"), F.max("v").alias("top"))
    share = F.col("top").cast("double") / F.col("total").cast("double")
    found = best.where(F.col("total") > 0).withColumn("share", share).where(F.col("share") > most)
    return found.select(*keys, F.format_string("Top company '%s' holds %.1f%% of fair value.", "name", F.col("share") * 100).alias("message"), F.array().cast("array<int>").alias("rows"))


def blank_industries(rows: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """VAL-6."""
    found = rows.where(_clean("industry") == "").groupBy(*keys).agg(_row_list(order).alias("rows"))
    return found.select(*keys, F.format_string("%d rows have no industry.", F.size("rows")).alias("message"), "rows")


def unknown_rows_present(unknown: DataFrame, keys: list[str]) -> DataFrame:
    """VAL-7."""
    found = unknown.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    return found.select(*keys, F.format_string("%d rows could not be classified.", "n").alias("message"), F.array().cast("array<int>").alias("rows"))


def report(rows: DataFrame, keys: list[str], documents: DataFrame | None = None, unknown: DataFrame | None = None, order: str = "row_no") -> DataFrame:
    """(keys, rule_no, level, code, message, rows) of all rules (VAL-8)."""
    found = {
        "BLANK_COMPANY": blank_companies(rows, keys, order), "COMPANY_IS_INDUSTRY": companies_that_are_industries(rows, keys, order), "RUNAWAY_COMPANY": runaway_companies(rows, keys),
        "COMPANY_MULTI_CATEGORY": companies_of_many_categories(rows, keys), "TOP_COMPANY_CONCENTRATED": concentrated(rows, keys, order=order), "BLANK_INDUSTRY": blank_industries(rows, keys, order),
    }
    if documents is not None:
        found["EMPTY_SCHEDULE"] = empty_schedules(documents, rows, keys)
    if unknown is not None:
        found["UNKNOWN_ROWS_PRESENT"] = unknown_rows_present(unknown, keys)
    out = None
    for no, (code, level) in enumerate(RULES):
        if code in found:
            part = found[code].select(*keys, F.lit(no).alias("rule_no"), F.lit(level).alias("level"), F.lit(code).alias("code"), "message", "rows")
            out = part if out is None else out.unionByName(part)
    return out


def verdicts(documents: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ok, errors, warnings): a document is ok without an error."""
    counts = issues.groupBy(*keys).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = documents.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("ok", F.col("errors") == 0)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order that has no ties (WIN-09, SET-01): unlike dropDuplicates, the same one each time."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")
