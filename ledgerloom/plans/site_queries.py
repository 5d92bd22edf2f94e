"""Queries over HTML pages and printed filings, built from whole tables so that the parsers run at size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, names, urls
from ledgerloom.operators import quality, schedule, site
from ledgerloom.plans import schedule_queries
from ledgerloom.plans import sql as S
from ledgerloom.session import table
from ledgerloom.sources import html
from ledgerloom.streaming import events

#: Each page's own text as HTML: a menu, people, its lines as paragraphs, headings, tables and a footer.
_LINES = "transform(split(coalesce(clean_text, ''), '\n'), x -> concat('<p>', x, '</p>'))"
_PAGE = (
    "concat('<html><head><title> ', coalesce(title, ''), ' </title><style>p {}</style></head><body><nav class=\"menu\"><a href=\"/about/\">About Us</a><a href=\"/about/\">About again</a><a href=\"https://away.example/x\">Away</a>',"
    " '<a href=\"/products/p', page_id % 5, '\">Our Products</a><a href=\"/blank/\"></a></nav><main><h2>', coalesce(company_name, 'Nobody'), '</h2><h3>Contact us now</h3>',"
    f" array_join({_LINES}, ''), '<table><tr><td>1<td>2<tr><td>3</table><table><tr><td>kept</table></main>',"
    " '<div class=\"team-member\"><h3>Ann Person', page_id % 7, '</h3><p>Chief Financial Officer</p><p>She has led the finances for ', page_id % 11, ' years.</p></div>',"
    " '<div class=\"team-member\"><h3>Bo Nobody</h3><p>Gardener</p></div><footer>Imprint</footer></body></html>')"
)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "website_page").withColumn("html", F.expr(_PAGE)).withColumn("base_url", F.col("website"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return html.scan_titles(pages(spark, d), ["page_id"])


PAGE_TITLES = f"SELECT page_id, {S.trim("coalesce(title, '')")} AS title FROM website_page"


def page_nav_links(spark: SparkSession, d: str) -> DataFrame:
    return site.menu_links(pages(spark, d), ["page_id"])


_BASE = "regexp_replace(website, '/+$', '')"
PAGE_NAV_LINKS = f"SELECT page_id, 0 AS ord, 'About Us' AS link_text, {_BASE} || '/about/' AS url FROM website_page UNION ALL SELECT page_id, 3, 'Our Products', {_BASE} || '/products/p' || page_id % 5 FROM website_page"


def page_frontier(spark: SparkSession, d: str) -> DataFrame:
    homes = pages(spark, d)
    extra = homes.withColumn("p", F.explode(urls.product_pages(F.concat(F.col("website"), F.lit("products/p1, "), F.col("website"), F.lit("extra/line"))))).select("page_id", F.lit(0).alias("ord"), "p.url", "p.label")
    return site.frontier(site.menu_links(homes, ["page_id"]), homes, ["page_id"], extra)


PAGE_FRONTIER = f"""SELECT page_id, {_BASE} || '/about/' AS url, 'About Us' AS label, 'about' AS type FROM website_page
  UNION ALL SELECT page_id, {_BASE} || '/products/p' || page_id % 5 || '/', 'Our Products', 'products' FROM website_page
  UNION ALL SELECT page_id, {_BASE} || '/about-us/', 'About Us', 'about' FROM website_page
  UNION ALL SELECT page_id, {_BASE} || '/products/p1/', 'p1', 'products' FROM website_page WHERE page_id % 5 <> 1 UNION ALL SELECT page_id, {_BASE} || '/extra/line/', 'line', 'products' FROM website_page"""


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return site.products(pages(spark, d), ["page_id"], tags=("h2", "h3"))


_OWN = "coalesce(company_name, 'Nobody')"
PAGE_HEADINGS = f"""SELECT page_id, CASE WHEN length({_OWN}) > 3 AND length({_OWN}) < 80 AND NOT regexp_matches(lower({_OWN}), '{site.NO_PRODUCT}') THEN [{_OWN}] ELSE [] END || ['Ann Person' || page_id % 7, 'Bo Nobody'] AS products FROM website_page"""


def page_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return site.page_table(pages(spark, d), ["page_id"])


_TEXT_LINES = f"list_filter(list_transform(list_concat([{_OWN}, 'Contact us now'], string_split(coalesce(clean_text, ''), chr(10)), ['1', '2', '3', 'kept']), lambda x: {S.trim('x')}), lambda x: x <> '')"
PAGE_CLEAN_TEXT = f"""WITH t AS (SELECT page_id, status_code, clean_text AS raw, substr(array_to_string({_TEXT_LINES}, chr(10)), 1, 3000) AS c FROM website_page)
  SELECT page_id, status_code, CASE WHEN status_code = 200 THEN c ELSE '' END AS clean_text,
    CASE WHEN status_code = 200 THEN list_sort(list_distinct(regexp_extract_all(coalesce(raw, ''), '{urls.EMAIL}'))) ELSE [] END AS emails,
    CASE WHEN status_code = 200 THEN list_sort(list_distinct(regexp_extract_all(c, '{urls.PHONE}'))) ELSE [] END AS phones,
    CASE WHEN status_code = 200 THEN NULL ELSE 'HTTP ' || coalesce(status_code, 0) END AS error FROM t"""


def page_leaders(spark: SparkSession, d: str) -> DataFrame:
    return site.leaders(pages(spark, d), ["website", "page_id"], ["website"]).select("website", "name", "title", "bio", "page_id")


PAGE_LEADERS = """SELECT website, 'Ann Person' || page_id % 7 AS name, 'Chief Financial Officer' AS title, 'She has led the finances for ' || page_id % 11 || ' years.' AS bio, page_id
  FROM (SELECT *, row_number() OVER (PARTITION BY website, page_id % 7 ORDER BY page_id) AS rn FROM website_page) WHERE rn = 1"""


def page_document_text(spark: SparkSession, d: str) -> DataFrame:
    """All text of a document without the first of its tables."""
    docs = pages(spark, d).withColumn("drop", F.array(F.lit(0)))
    return html.scan_text(docs, ["page_id"], sep="|", drop="drop").select("page_id", F.length("text").alias("chars"), F.substring_index("text", "|", -7).alias("tail"))


_PARTS = f"""list_filter(list_concat([' ' || coalesce(title, '') || ' ', 'About Us', 'About again', 'Away', 'Our Products', {_OWN}, 'Contact us now'], string_split(coalesce(clean_text, ''), chr(10)), ['kept', 'Ann Person' || page_id % 7, 'Chief Financial Officer', 'She has led the finances for ' || page_id % 11 || ' years.', 'Bo Nobody', 'Gardener', 'Imprint']), lambda x: x <> '')"""
PAGE_DOCUMENT_TEXT = f"SELECT page_id, length(t)::INTEGER AS chars, array_to_string(p[-7:], '|') AS tail FROM (SELECT page_id, {_PARTS} AS p, array_to_string({_PARTS}, '|') AS t FROM website_page)"


#: Each filing as the tables that it would print: a header, then sections, companies and investments, ten investments a table.
_KINDS = {
    0: "array('Portfolio Company (a)', 'Investment Type', 'Cost', 'Fair Value')",
    1: "array(concat(if(row_no % 2 = 0, 'Affiliate', 'Control'), ' Investments'), '')",
    2: "array(concat('Company ', row_no, ' (a)'), 'Industry of it', '')",
    3: "array('First Lien Debt (n)', '(S+7.75%) / (2.00%)', '11.71%/0.50%', '1/15/2024', '1/15/2029', '$', format_number(row_no * 1000, 0), '$', '990', '$', if(row_no % 2 = 0, '1,050', concat('(', row_no)), if(row_no % 2 = 0, '', ')'))",
    4: "array('', 'odd', 'words', 'that', 'say', 'nothing', 'known')",
}


def printed_filings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, table_idx, row_idx, cells, row_text) of every filing, one line of each kind for each row number."""
    rows = table(spark, d, "investment").select(F.col("filing_id").alias("doc_id"), "row_no").distinct()
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(v).alias("cells")) for k, v in _KINDS.items()))
    every = rows.select("doc_id", "row_no", F.explode(kinds).alias("x")).where("x.kind <> 0 OR row_no = 1")
    at = F.expr("cast((row_no - 1) div 10 as int)")
    return every.select("doc_id", at.alias("table_idx"), (F.col("row_no") * 5 + F.when(F.col("x.kind") == 0, -5).otherwise(F.col("x.kind")) - F.when(F.col("row_no") > 10, 0).otherwise(0)).alias("row_idx"), "x.cells", F.array_join("x.cells", "").alias("row_text"))


def schedule_all(spark: SparkSession, d: str) -> DataFrame:
    """Every filing from printed rows to typed ones."""
    return schedule.assemble(printed_filings(spark, d)).select("doc_id", "row_no", "company_name", "industry", "investment_category", "investment_type", "principal_amount", "cost", "fair_value", "rate_reference", "rate_floor_pct")


_FILED = "SELECT DISTINCT filing_id AS doc_id, row_no FROM investment"
_TABLES = f"SELECT doc_id, row_no, (row_no - 1) // 10 AS t, count(*) OVER (PARTITION BY doc_id, (row_no - 1) // 10) AS n FROM ({_FILED}) WHERE doc_id IN (SELECT doc_id FROM ({_FILED}) WHERE row_no = 1)"
# a table of fewer than three investments has no data; only up to two tables may be missing between two of a group
SCHEDULE_ALL = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_no)::INTEGER AS row_no, 'Company ' || row_no AS company_name, 'Industry of it' AS industry, CASE WHEN row_no % 2 = 0 THEN 'Affiliate' ELSE 'Control' END AS investment_category,
  'First Lien Debt' AS investment_type, (row_no * 1000)::VARCHAR AS principal_amount, '990' AS cost, CASE WHEN row_no % 2 = 0 THEN '1050' ELSE '-' || row_no END AS fair_value, 'SOFR' AS rate_reference, '2.0' AS rate_floor_pct
  FROM ({_TABLES}) WHERE t = 0 OR n >= 3"""


def schedule_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = printed_filings(spark, d)
    tables = schedule.islands(schedule.table_signs(rows))
    return schedule.diagnostics(rows, tables).select("doc_id", "group_no", "n_rows", "sections", "quirks", F.size("totals").alias("totals"))


SCHEDULE_DIAGNOSTICS = f"""SELECT doc_id, 1 AS group_no, count(*) * 4 + 1 AS n_rows, CASE WHEN max(row_no) > 1 THEN ['Affiliate Investments', 'Control Investments'] ELSE ['Control Investments'] END AS sections, ['Footnote markers'] AS quirks, 0 AS totals
  FROM ({_TABLES}) WHERE t = 0 OR n >= 3 GROUP BY doc_id"""


def schedule_samples(spark: SparkSession, d: str) -> DataFrame:
    return schedule.sample_rows(printed_filings(spark, d)).select("doc_id", "table_idx", "n", F.size("cells").alias("cells"), F.col("cells")[0].alias("first"))


SCHEDULE_SAMPLES = f"""WITH r AS (SELECT doc_id, (row_no - 1) // 10 AS table_idx, row_no, k, CASE k WHEN 3 THEN 11 + CASE WHEN row_no % 2 = 0 THEN 0 ELSE 1 END ELSE 6 END AS cells, CASE k WHEN 3 THEN 'First Lien Debt (n)' ELSE 'odd' END AS first
    FROM ({_FILED}), (VALUES (3), (4)) v(k)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY row_no, k)::INTEGER AS n FROM r)
  SELECT doc_id, table_idx::INTEGER AS table_idx, n, cells::INTEGER AS cells, first FROM n WHERE n <= 3"""


def schedule_unknown_rows(spark: SparkSession, d: str) -> DataFrame:
    return schedule.unknown_rows(printed_filings(spark, d)).select("doc_id", "table_idx", "cells")


SCHEDULE_UNKNOWN_ROWS = f"SELECT doc_id, ((row_no - 1) // 10)::INTEGER AS table_idx, ['odd', 'words', 'that', 'say', 'nothing'] AS cells FROM ({_FILED})"


def dq_triggered(spark: SparkSession, d: str) -> DataFrame:
    """All rules over rows by ticker that break each of them, with a filing without rows and the rows that no rule knows."""
    name = "CASE WHEN inv_id % 3 = 0 THEN industry WHEN inv_id % 3 = 1 THEN 'Mono Holdings' ELSE company_name END"
    rows = table(spark, d, "investment").select(F.col("ticker").alias("filing_id"), F.col("inv_id").cast("int").alias("row_no"), F.expr(name).alias("company_name"), "industry", "investment_category", "investment_type", "fair_value")
    filings = table(spark, d, "filing").select(F.col("ticker").alias("filing_id")).unionByName(spark.createDataFrame([("NONE",)], "filing_id STRING"))
    unknown = printed_filings(spark, d).transform(schedule.unknown_rows).select(F.substring_index("doc_id", "-", 1).alias("filing_id"))
    return quality.report(rows, ["filing_id"], documents=filings, unknown=unknown)


def _dq_triggered_sql() -> str:
    rows = "(SELECT ticker AS filing_id, inv_id::INTEGER AS row_no, CASE WHEN inv_id % 3 = 0 THEN industry WHEN inv_id % 3 = 1 THEN 'Mono Holdings' ELSE company_name END AS company_name, industry, investment_category, fair_value FROM investment)"
    sql = schedule_queries.DQ_REPORT.replace("FROM investment)", f"FROM {rows})").replace("(SELECT DISTINCT filing_id FROM filing)", "(SELECT DISTINCT ticker AS filing_id FROM filing UNION SELECT 'NONE')")
    return f"{sql} UNION ALL SELECT string_split(doc_id, '-')[1], 7, 'warning', 'UNKNOWN_ROWS_PRESENT', count(*) || ' rows could not be classified.', {schedule_queries.NO_ROWS} FROM ({_FILED}) GROUP BY 1"


def rates_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rates that stayed incomplete go through a hook, here one that says it has been asked; the others do not."""
    from ledgerloom.functions import rates

    parsed = table(spark, d, "investment").select("inv_id", rates.parse_rate(F.col("rate_spread_floor"), F.col("rate_cash_pik")).alias("r"))
    asked = lambda df: df.withColumn("r", F.col("r").withField("parsed_by", F.lit("llm")))
    return rates.with_fallback(parsed, "r", asked).select("inv_id", "r.parsed_by")


RATES_FALLBACK = f"SELECT inv_id, CASE WHEN incomplete AND parsed_by = 'regex' THEN 'llm' ELSE parsed_by END AS parsed_by FROM ({schedule_queries.RATE_TERMS})"


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names with a word marked, and values as a report prints them."""
    v = amounts.optional(F.col("fair_value"))
    return table(spark, d, "investment").select("inv_id", names.highlight(F.col("company_name"), "hold").alias("marked"), amounts.money(v).alias("money"), amounts.signed_money(v).alias("signed"), amounts.percent(F.col("row_no") / 37).alias("share"))


_V = S.amount("fair_value")
_MONEY = f"CASE WHEN round({_V}) = 0 AND {_V} < 0 THEN '-0' ELSE format('{{:,}}', round_even({_V}, 0)::BIGINT) END"
REPORT_TEXTS = f"""SELECT inv_id, regexp_replace(company_name, '(?i)(hold)', '>>> \\1 <<<', 'g') AS marked, {_MONEY} AS money, CASE WHEN {_V} >= 0 THEN '+' ELSE '' END || {_MONEY} AS signed, printf('%.1f%%', row_no / 37 * 100) AS share FROM investment"""


def events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events sent twice count once."""
    sent = table(spark, d, "events")
    return events.distinct_events(sent.unionByName(sent)).groupBy("event_type").agg(F.count("*").alias("n"))


EVENTS_ONCE = "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type"

ALL = {
    "page_titles": (page_titles, PAGE_TITLES), "page_nav_links": (page_nav_links, PAGE_NAV_LINKS), "page_frontier": (page_frontier, PAGE_FRONTIER), "page_headings": (page_headings, PAGE_HEADINGS),
    "page_clean_text": (page_clean_text, PAGE_CLEAN_TEXT), "page_leaders": (page_leaders, PAGE_LEADERS), "page_document_text": (page_document_text, PAGE_DOCUMENT_TEXT),
    "schedule_all": (schedule_all, SCHEDULE_ALL), "schedule_diagnostics": (schedule_diagnostics, SCHEDULE_DIAGNOSTICS), "schedule_samples": (schedule_samples, SCHEDULE_SAMPLES), "schedule_unknown_rows": (schedule_unknown_rows, SCHEDULE_UNKNOWN_ROWS),
    "dq_triggered": (dq_triggered, _dq_triggered_sql()), "rates_fallback": (rates_fallback, RATES_FALLBACK), "report_texts": (report_texts, REPORT_TEXTS), "events_once": (events_once, EVENTS_ONCE),
}
