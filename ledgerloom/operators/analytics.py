"""Rankings and sums over schedules.

Amounts are summed as decimals, so that a sum does not depend on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import lenient, optional, strict


def filled(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def company_totals(rows: DataFrame, keys: list[str], order: str = "row_no", exact: bool = False) -> DataFrame:
    """A row for each company within keys: sums, number of investments, its types and its first industry and category (AGG-01).

    exact: malformed amounts raise; else they count as nothing. Rows of null company are a company of their own.
    """
    value = strict if exact else optional
    first = lambda c: F.min_by(c, F.struct(order, c))
    return rows.groupBy(*keys, "company_name").agg(
        F.coalesce(F.sum(value(F.col("fair_value"))), F.lit(0)).cast("double").alias("total_fair_value"),
        F.coalesce(F.sum(value(F.col("cost"))), F.lit(0)).cast("double").alias("total_cost"),
        F.count("*").alias("num_investments"),
        F.concat_ws("; ", F.array_sort(F.collect_set("investment_type"))).alias("investment_types"),
        first("industry").alias("industry"),
        first("investment_category").alias("investment_category"),
        F.min(order).alias("first_row"),
    )


def ranked(totals: DataFrame, keys: list[str]) -> DataFrame:
    """totals and rank from 1 within keys, by fair value, ties by first row and name (WIN-03). Without keys, rank a limited table."""
    order = [F.desc("total_fair_value"), F.asc("first_row"), F.asc_nulls_first("company_name")]
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(totals: DataFrame, n: int) -> DataFrame:
    """The n largest companies of all (TOP-01): a top-n for each task, then one small sort."""
    few = totals.orderBy(F.desc("total_fair_value"), F.asc("first_row"), F.asc_nulls_first("company_name")).limit(n)
    return ranked(few, [])


def runners_up(totals: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Ranks n+1 to n+10 of each group that has as many companies (TOP-02)."""
    counted = ranked(totals, keys).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return counted.where((F.col("__n") >= n + 10) & F.col("rank").between(n + 1, n + 10)).drop("__n")


def concentration(totals: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The share in percent of the n largest in each group's fair value; null where that is 0 (AGG-10)."""
    # each total is a decimal of two places printed as a double: as a decimal again, sums do not depend on partitions
    by_rank = ranked(totals, keys).withColumn("__v", F.col("total_fair_value").cast("decimal(30,2)"))
    some = F.sum(F.when(F.col("rank") <= n, F.col("__v")).otherwise(0))
    sums = by_rank.groupBy(*keys).agg(F.sum("__v").cast("double").alias("total"), some.cast("double").alias("top_total"), F.count("*").alias("companies"))
    return sums.withColumn("top_share_pct", F.when(F.col("total") != 0, F.col("top_total") / F.col("total") * 100))


def breakdown(rows: DataFrame, column: str, order: str = "row_no") -> DataFrame:
    """Number of rows and fair value by the values of a column, most first (AGG-03 to AGG-05, TOP-05)."""
    sums = rows.groupBy(column).agg(F.count("*").alias("n"), F.coalesce(F.sum(optional(F.col("fair_value"))), F.lit(0)).cast("double").alias("fair_value"), F.min(order).alias("first_row"))
    return sums.orderBy(F.desc("n"), "first_row")


def reconciliation(rows: DataFrame, keys: list[str], expected: Column | None = None) -> DataFrame:
    """Fair value in all, the rows without one, the number of companies and the difference to an expected total (AGG-02, AGG-11)."""
    value = optional(F.col("fair_value"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("total_fair_value"), F.count_if(value.isNull()).alias("missing_fair_value"), F.count_distinct("company_name").alias("companies"))
    return sums.withColumn("difference", F.col("total_fair_value") - expected) if expected is not None else sums


def deep_dive(rows: DataFrame, target: str, order: list[str]) -> DataFrame:
    """One document on the companies whose name contains target, in any case; no row where none does (FLT-07, AGG-06).

    Its name and category are those of the first row, its sums those of all; the rows have null for ''.
    """
    columns = [c for c in rows.columns]
    found = rows.where(F.lower("company_name").contains(target.lower()))
    nulled = F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in columns))
    at = F.struct(*order)
    out = found.agg(
        F.min_by("company_name", at).alias("company_name"),
        F.coalesce(F.sum(lenient(F.col("fair_value"))), F.lit(0)).cast("double").alias("total_fair_value"),
        F.coalesce(F.sum(lenient(F.col("cost"))), F.lit(0)).cast("double").alias("total_cost"),
        F.count("*").alias("num_investments"),
        F.array_sort(F.collect_set("investment_type")).alias("investment_types"),
        F.min_by("investment_category", at).alias("investment_category"),
        F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), nulled.alias("row")))), lambda x: x["row"]).alias("schedule_rows"),
    )
    return out.where("num_investments > 0")
