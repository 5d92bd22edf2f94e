"""Schedules of investments out of the tables of filings: which tables, which rows, which context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import cells as C
from ledgerloom.functions.names import strip_footnotes, trim_all
from ledgerloom.functions.rates import parse_rate

#: Labels and signs of schedule tables.
MARKERS = ["Control Investments", "Affiliate Investments", "Non-control/Non-affiliate Investments"]
TOTALS = "Total Control Investments|Total Affiliate Investments|Total Non-control|Total Investments\\b"
HEADER_PHRASES = ("portfolio company", "investment type")
ROW_DATE, ROW_RATE, ROW_KIND = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", r"[0-9]+\.[0-9]+%", "(?:First|Second) Lien|Subordinated|Equity|Warrant"
QUIRKS = [("PIK interest", "PIK"), ("Non-accrual", "(?i)non-accrual"), ("Footnote markers", r"\([a-z]{1,2}\)"), ("Unfunded commitments", "(?i)unfunded commitment"), ("Warrants", "Warrant")]


def table_signs(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, table_idx, is_header, has_data): the two signs of each table (FLT-01, FLT-02), in one aggregation."""
    low = F.lower("row_text")
    joined = F.array_join("cells", " ")
    invest = joined.rlike(ROW_DATE) & (joined.rlike(ROW_RATE) | joined.rlike(ROW_KIND))
    head = F.col("row_idx") < 5
    signs = rows.groupBy(doc, "table_idx").agg(
        *(F.max(F.when(head & low.contains(p), 1).otherwise(0)).alias(f"__h{i}") for i, p in enumerate(HEADER_PHRASES)),
        F.count_if(invest).alias("__n"),
    )
    return signs.select(doc, "table_idx", (F.col("__h0") + F.col("__h1") == 2).alias("is_header"), (F.col("__n") >= 3).alias("has_data"))


def islands(signs: DataFrame, doc: str = "doc_id", index: str = "table_idx", gap: int = 2) -> DataFrame:
    """(doc, group_no, header, index) of the tables of each group (WIN-02).

    A header opens a group; a table with data joins it while it lies at most gap behind the last one that joined, and after the
    first wider gap nothing joins until the next header. Windows are within a document.
    """
    order = Window.partitionBy(doc).orderBy(index)
    grouped = signs.withColumn("group_no", F.sum(F.col("is_header").cast("int")).over(order)).where((F.col("group_no") > 0) & (F.col("is_header") | F.col("has_data")))
    within = Window.partitionBy(doc, "group_no").orderBy(index)
    broken = F.coalesce(F.col(index) - F.lag(index).over(within) > gap, F.lit(False)).cast("int")
    out = grouped.withColumn("__broken", broken).withColumn("__broken", F.sum("__broken").over(within)).withColumn("header", F.first(index).over(within))
    return out.where("__broken = 0").select(doc, F.col("group_no").cast("int").alias("group_no"), "header", index)


def groups(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, group_no, header_table, tables ARRAY<INT>)."""
    return tables.groupBy(doc, "group_no").agg(F.min("header").alias("header_table"), F.array_sort(F.collect_list("table_idx")).alias("tables"))


def fill_down(df: DataFrame, partition: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """df and, for each name, the latest value not null of its expression so far (WIN-01, JN-05)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(c, ignorenulls=True).over(w) for name, c in columns.items()})


def assemble(rows: DataFrame, doc: str = "doc_id", group_no: int = 1) -> DataFrame:
    """The 17 columns of each investment row of a document's group, and row_no from 1.

    rows: doc, table_idx, row_idx, cells, row_text. The section gives the category and the company row the company and its
    industry, carried forward over rows and tables; a new section keeps the company until the next one. One shuffle by document.
    """
    chosen = islands(table_signs(rows, doc), doc).where(F.col("group_no") == group_no).select(doc, "table_idx")
    own = rows.join(chosen, [doc, "table_idx"], "left_semi").withColumn("kind", C.classify_row(F.col("cells")))
    first = trim_all(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    ne = C.filled(F.col("cells"))
    company = F.col("kind") == "COMPANY"
    carried = fill_down(own, [doc], ["table_idx", "row_idx"], {
        "investment_category": F.when(F.col("kind") == "SECTION", C.section_label(first)),
        "company_name": F.when(company, strip_footnotes(first)),
        "industry": F.when(company, F.coalesce(F.get(ne, F.lit(1)), F.lit(""))),
    })
    fields = C.extract_fields(F.col("cells"))
    invest = carried.where(F.col("kind") == "INVEST").withColumn("f", fields)
    invest = invest.withColumn("r", parse_rate(F.col("f.rate_spread_floor"), F.col("f.rate_cash_pik")))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("table_idx", "row_idx"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return invest.select(
        doc, number.alias("row_no"), F.coalesce("company_name", F.lit("")).alias("company_name"), F.coalesce("industry", F.lit("")).alias("industry"),
        F.coalesce("investment_category", F.lit("Unknown")).alias("investment_category"),
        *(F.col(f"f.{c}").alias(c) for c in ("investment_type", "rate_spread_floor", "rate_cash_pik", "investment_date", "maturity_date", "principal_amount", "cost", "fair_value")),
        text("r.reference").alias("rate_reference"), text("r.spread_pct").alias("rate_spread_pct"), text("r.floor_pct").alias("rate_floor_pct"),
        text("r.cash_pct").alias("rate_cash_pct"), text("r.pik_pct").alias("rate_pik_pct"), F.col("r.parsed_by").alias("rate_parsed_by"),
    )


def unknown_rows(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, table_idx, row_idx, cells): the rows that no rule knows, with at least two filled cells; their first five (FLT-19)."""
    known = rows.withColumn("ne", C.filled(F.col("cells"))).where((C.classify_row(F.col("cells")) == "UNKNOWN") & (F.size("ne") >= 2))
    return known.select(doc, "table_idx", "row_idx", F.slice("ne", 1, 5).alias("cells"))


def diagnostics(rows: DataFrame, tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row for each group: number of rows, section markers, totals and quirks seen (FLT-15, FLT-16, FLT-18, AGG-13)."""
    low = F.lower("row_text")
    markers = F.filter(F.array(*map(F.lit, MARKERS)), lambda m: low.contains(F.lower(m)) & ~low.contains("total"))
    amount = F.element_at(F.regexp_extract_all("row_text", F.lit("[0-9,]+"), F.lit(0)), -1)
    total = F.when(F.col("row_text").rlike(f"(?i)(?:{TOTALS})"), F.concat(trim_all(F.substring("row_text", 1, 60)), F.lit(" → $"), F.coalesce(amount, F.lit("?"))))
    quirks = F.array_compact(F.array(*(F.when(F.col("row_text").rlike(p), name) for name, p in QUIRKS)))
    own = rows.join(tables, [doc, "table_idx"])
    return own.groupBy(doc, "group_no").agg(
        F.count("*").alias("n_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(markers)))).alias("sections"),
        F.array_sort(F.collect_set(total)).alias("totals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(quirks)))).alias("quirks"),
    )


def sample_rows(rows: DataFrame, doc: str = "doc_id", n: int = 3) -> DataFrame:
    """The first n rows of each table that look like entries, each cell cut at 55 characters (FLT-17)."""
    ne = F.filter("cells", lambda c: c != "")
    joined = F.lower(F.array_join(ne, " "))
    header = joined.contains(HEADER_PHRASES[0]) & joined.contains(HEADER_PHRASES[1])
    section = reduce(lambda a, b: a | b, (joined.contains(m.lower()) for m in MARKERS)) & (F.size(ne) < 5)
    kept = rows.where((F.size(ne) >= 3) & ~header & ~section)
    at = F.row_number().over(Window.partitionBy(doc, "table_idx").orderBy("row_idx"))
    return kept.withColumn("n", at).where(F.col("n") <= n).select(doc, "table_idx", "n", F.transform(ne, lambda c: F.substring(c, 1, 55)).alias("cells"))
