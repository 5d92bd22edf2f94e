"""Queries over schedules of investments: amounts, rates, rows, rankings and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, cells, names, rates
from ledgerloom.operators import analytics, badrows, quality, schedule
from ledgerloom.plans import sql as S
from ledgerloom.session import table
from ledgerloom.sources import files, html

KEYS = ["filing_id"]


def investments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "investment")


def rank_topn(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest companies of each filing."""
    out = analytics.ranked(analytics.company_totals(investments(spark, d), KEYS), KEYS).where("rank <= 10")
    return out.drop("first_row")


TOTALS_SQL = f"""
  SELECT {{keys}}company_name, coalesce(sum({S.amount('fair_value')}), 0)::DOUBLE AS total_fair_value, coalesce(sum({S.amount('cost')}), 0)::DOUBLE AS total_cost,
    count(*) AS num_investments, coalesce(string_agg(DISTINCT investment_type, '; ' ORDER BY investment_type), '') AS investment_types,
    max(CASE WHEN rn = 1 THEN industry END) AS industry, max(CASE WHEN rn = 1 THEN investment_category END) AS investment_category, min({{order}}) AS first_row
  FROM (SELECT *, row_number() OVER (PARTITION BY {{keys}}company_name ORDER BY {{order}}, inv_id) AS rn FROM investment) GROUP BY {{keys}}company_name"""
RANKED_SQL = "SELECT *, row_number() OVER ({part} ORDER BY total_fair_value DESC, first_row, company_name NULLS FIRST)::INTEGER AS rank FROM ({totals})"


def totals_sql(keys: str = "filing_id, ", order: str = "row_no") -> str:
    return TOTALS_SQL.format(keys=keys, order=order)


RANK_TOPN = f"SELECT * EXCLUDE (first_row) FROM ({RANKED_SQL.format(part='PARTITION BY filing_id', totals=totals_sql())}) WHERE rank <= 10"


def top_companies(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest companies of all filings."""
    return analytics.top(analytics.company_totals(investments(spark, d), [], "inv_id"), 10).drop("first_row")


TOP_COMPANIES = f"SELECT * EXCLUDE (first_row) FROM ({RANKED_SQL.format(part='', totals=totals_sql('', 'inv_id'))}) WHERE rank <= 10"


def rank_runners_up(spark: SparkSession, d: str) -> DataFrame:
    return analytics.runners_up(analytics.company_totals(investments(spark, d), ["ticker"], "inv_id"), ["ticker"], 10).select("ticker", "rank", "company_name", "total_fair_value")


RANK_RUNNERS_UP = f"""SELECT ticker, rank, company_name, total_fair_value FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n
  FROM ({RANKED_SQL.format(part='PARTITION BY ticker', totals=totals_sql('ticker, ', 'inv_id'))})) WHERE n >= 20 AND rank BETWEEN 11 AND 20"""


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return analytics.concentration(analytics.company_totals(investments(spark, d), ["ticker"], "inv_id"), ["ticker"], 10).select("ticker", "companies", F.round("total", 2).alias("total"), F.round("top_total", 2).alias("top_total"), F.round("top_share_pct", 3).alias("top_share_pct"))


CONCENTRATION = f"""SELECT ticker, count(*) AS companies, round(sum(total_fair_value), 2) AS total, round(sum(CASE WHEN rank <= 10 THEN total_fair_value ELSE 0 END), 2) AS top_total,
  CASE WHEN sum(total_fair_value) <> 0 THEN round(sum(CASE WHEN rank <= 10 THEN total_fair_value ELSE 0 END) / sum(total_fair_value) * 100, 3) END AS top_share_pct
  FROM ({RANKED_SQL.format(part='PARTITION BY ticker', totals=totals_sql('ticker, ', 'inv_id'))}) GROUP BY ticker"""


def _breakdown(column: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return analytics.breakdown(investments(spark, d), column, "inv_id")

    query.__name__ = f"breakdown_{column}"
    return query, f"SELECT {column}, count(*) AS n, coalesce(sum({S.amount('fair_value')}), 0)::DOUBLE AS fair_value, min(inv_id) AS first_row FROM investment GROUP BY {column}"


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.reconciliation(investments(spark, d), KEYS)


RECONCILIATION = f"""SELECT filing_id, count(*) AS n_rows, coalesce(sum({S.amount('fair_value')}), 0)::DOUBLE AS total_fair_value,
  count(*) FILTER (WHERE {S.amount('fair_value')} IS NULL) AS missing_fair_value, count(DISTINCT company_name) AS companies FROM investment GROUP BY filing_id"""


def deep_dive(spark: SparkSession, d: str) -> DataFrame:
    rows = investments(spark, d).select("inv_id", *badrows.SCHEDULE_COLUMNS)
    out = analytics.deep_dive(rows, "logistics", ["inv_id"])
    return out.withColumn("n_rows", F.size("schedule_rows")).drop("schedule_rows")


DEEP_DIVE = f"""SELECT (SELECT company_name FROM investment WHERE inv_id = min(i.inv_id)) AS company_name, coalesce(sum(coalesce({S.amount('i.fair_value')}, 0)), 0)::DOUBLE AS total_fair_value,
  coalesce(sum(coalesce({S.amount('i.cost')}, 0)), 0)::DOUBLE AS total_cost, count(*) AS num_investments, list_sort(list_distinct(list(i.investment_type))) AS investment_types,
  (SELECT investment_category FROM investment WHERE inv_id = min(i.inv_id)) AS investment_category, count(*)::INTEGER AS n_rows
  FROM investment i WHERE lower(i.company_name) LIKE '%logistics%' HAVING count(*) > 0"""


def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """All rules over every filing, with the filings that have no row at all."""
    return quality.report(investments(spark, d), KEYS, documents=table(spark, d, "filing"))


NAME, INDUSTRY, CATEGORY = (S.trim(f"coalesce({c}, '')") for c in ("company_name", "industry", "investment_category"))
NO_ROWS = "[]::INTEGER[]"
DQ_REPORT = f"""WITH r AS (SELECT filing_id, row_no, {NAME} AS name, {INDUSTRY} AS industry, {CATEGORY} AS category, coalesce({S.amount('fair_value')}, 0) AS v FROM investment),
  inds AS (SELECT DISTINCT filing_id, industry AS name FROM r WHERE industry <> ''),
  runs AS (SELECT filing_id, name, count(*) AS n FROM r WHERE name <> '' GROUP BY ALL HAVING count(*) > 50),
  many AS (SELECT filing_id, name FROM r WHERE name <> '' AND category <> '' GROUP BY ALL HAVING count(DISTINCT category) > 1),
  sums AS (SELECT filing_id, name, sum(v) AS v, min(row_no) AS first FROM r WHERE name <> '' GROUP BY ALL),
  best AS (SELECT *, sum(v) OVER (PARTITION BY filing_id) AS total, row_number() OVER (PARTITION BY filing_id ORDER BY v DESC, first) AS rn FROM sums)
  SELECT filing_id, 0 AS rule_no, 'error' AS level, 'EMPTY_SCHEDULE' AS code, 'No investment rows.' AS message, {NO_ROWS} AS rows FROM (SELECT DISTINCT filing_id FROM filing) f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.filing_id = f.filing_id)
  UNION ALL SELECT filing_id, 1, 'error', 'BLANK_COMPANY', count(*) || ' rows have an empty company_name.', list_sort(list(row_no)) FROM r WHERE name = '' GROUP BY filing_id
  UNION ALL SELECT filing_id, 2, 'error', 'COMPANY_IS_INDUSTRY', count(*) || ' rows have an industry as company_name: ' || array_to_string(list_sort(list_distinct(list(name)))[1:5], ', ') || '.', list_sort(list(row_no)) FROM r SEMI JOIN inds USING (filing_id, name) GROUP BY filing_id
  UNION ALL SELECT filing_id, 3, 'error', 'RUNAWAY_COMPANY', count(*) || ' companies have more than 50 rows: ' || array_to_string(list(name || ' (' || n || ')' ORDER BY n DESC, name)[1:3], ', ') || '.', {NO_ROWS} FROM runs GROUP BY filing_id
  UNION ALL SELECT filing_id, 4, 'warning', 'COMPANY_MULTI_CATEGORY', count(*) || ' companies span categories: ' || array_to_string(list_sort(list(name))[1:3], ', ') || '.', {NO_ROWS} FROM many GROUP BY filing_id
  UNION ALL SELECT filing_id, 5, 'warning', 'TOP_COMPANY_CONCENTRATED', 'Top company ''' || name || ''' holds ' || format('{{:.1f}}', v::DOUBLE / total::DOUBLE * 100) || '% of fair value.', {NO_ROWS} FROM best WHERE rn = 1 AND total > 0 AND v::DOUBLE / total::DOUBLE > 0.4
  UNION ALL SELECT filing_id, 6, 'warning', 'BLANK_INDUSTRY', count(*) || ' rows have no industry.', list_sort(list(row_no)) FROM r WHERE industry = '' GROUP BY filing_id"""


def dq_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdicts(table(spark, d, "filing"), dq_report(spark, d), KEYS)


DQ_VERDICTS = f"""SELECT filing_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS ok FROM (SELECT DISTINCT filing_id FROM filing) LEFT JOIN
  (SELECT filing_id, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings FROM ({DQ_REPORT}) GROUP BY filing_id) USING (filing_id)"""


def _rule(name: str, code: str, make):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return make(investments(spark, d), KEYS).select("filing_id", "message", "rows")

    query.__name__ = name
    return query, f"SELECT filing_id, message, rows FROM ({DQ_REPORT}) WHERE code = '{code}'"


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stored issues by code: how many, in how many filings, with how many rows named, repeated ones once."""
    once = table(spark, d, "validation_issue").select("filing_id", "issue_level", "code", F.coalesce("message", F.lit("")).alias("message"), "row_nos").distinct()
    return once.groupBy("issue_level", "code").agg(F.count("*").alias("n"), F.count_distinct("filing_id").alias("filings"), F.sum(F.coalesce(F.size("row_nos"), F.lit(0))).alias("rows_named"))


ISSUE_COUNTS = """SELECT issue_level, code, count(*) AS n, count(DISTINCT filing_id) AS filings, sum(coalesce(len(row_nos), 0))::BIGINT AS rows_named
  FROM (SELECT DISTINCT filing_id, issue_level, code, coalesce(message, '') AS message, row_nos FROM validation_issue) GROUP BY issue_level, code"""


def amount_clean(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return investments(spark, d).select("inv_id", amounts.clean_amount(c("cost")).alias("cost_text"), amounts.optional(c("fair_value")).cast("double").alias("fair_value"), amounts.lenient(c("principal_amount")).cast("double").alias("principal"))


AMOUNT_CLEAN = f"SELECT inv_id, {S.amount_text('cost')} AS cost_text, {S.amount('fair_value')}::DOUBLE AS fair_value, coalesce({S.amount('principal_amount')}, 0)::DOUBLE AS principal FROM investment"


def rate_terms(spark: SparkSession, d: str) -> DataFrame:
    out = investments(spark, d).withColumn("r", rates.parse_rate(F.col("rate_spread_floor"), F.col("rate_cash_pik")))
    return out.select("inv_id", "r.*", rates.incomplete(F.col("r")).alias("incomplete"))


N = "([0-9.]+)"
RATE_TERMS = f"""WITH c AS (SELECT inv_id, CASE WHEN {S.trim("coalesce(rate_spread_floor, '')")} IN ('', '-', '--', '—') THEN '' ELSE {S.trim('rate_spread_floor')} END AS a,
    CASE WHEN {S.trim("coalesce(rate_cash_pik, '')")} IN ('', '-', '--', '—') THEN '' ELSE {S.trim('rate_cash_pik')} END AS b FROM investment),
  l AS (SELECT *, {S.extracted('a', r'\(\s*([SPLB])\s*\+\s*[0-9.]+\s*%\s*\)')} AS letter, regexp_matches(b, '^\\s*{N}\\s*%\\s*/\\s*{N}\\s*%\\s*$') AS paired FROM c),
  r AS (SELECT inv_id, a, b, CASE letter WHEN 'S' THEN 'SOFR' WHEN 'P' THEN 'Prime' WHEN 'L' THEN 'LIBOR' WHEN 'B' THEN 'Base Rate' ELSE upper({S.extracted('a', r'(?i)\b(SOFR|LIBOR|Prime|Base Rate)\b')}) END AS reference,
    CASE WHEN letter IS NOT NULL THEN {S.number('a', rf'\(\s*[SPLB]\s*\+\s*{N}\s*%\s*\)')} ELSE {S.number('a', rf'\+\s*{N}\s*%')} END AS spread_pct,
    coalesce({S.number('a', rf'\)\s*/\s*\(\s*{N}\s*%\s*\)')}, {S.number('a', rf'(?i){N}\s*%\s*floor')}) AS floor_pct,
    CASE WHEN paired THEN {S.number('b', rf'^\s*{N}\s*%\s*/\s*{N}\s*%\s*$')} ELSE coalesce({S.number('b', rf'(?i){N}\s*%\s*cash')}, CASE WHEN {S.number('b', rf'(?i){N}\s*%\s*PIK')} IS NULL THEN {S.number('b', rf'^\s*{N}\s*%\s*$')} END) END AS cash_pct,
    CASE WHEN paired THEN {S.number('b', rf'^\s*{N}\s*%\s*/\s*{N}\s*%\s*$', 2)} ELSE {S.number('b', rf'(?i){N}\s*%\s*PIK')} END AS pik_pct FROM l)
  SELECT inv_id, reference, spread_pct, floor_pct, cash_pct, pik_pct, concat_ws(' | ', NULLIF(a, ''), NULLIF(b, '')) AS raw, CASE WHEN a = '' AND b = '' THEN 'none' ELSE 'regex' END AS parsed_by,
    NOT ((reference IS NOT NULL AND spread_pct IS NOT NULL) OR cash_pct IS NOT NULL) AS incomplete FROM r"""


def name_footnotes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("company_name")
    return table(spark, d, "borrower_name").select("name_id", names.strip_footnotes(n).alias("name"), names.slug(n).alias("slug"))


_BARE = r"regexp_replace(regexp_replace(company_name, '\s*\(fka\s+[^)]+\)', '', 'g'), '\s*\([a-z]{1,3}\)', '', 'g')"
_DBA = r"regexp_extract(company_name, '\(dba\s+[^)]+\)', 0)"
NAME_FOOTNOTES = f"""SELECT name_id, {S.trim(f"CASE WHEN {_DBA} <> '' AND {_BARE} NOT LIKE '%dba%' THEN {S.trim(_BARE)} || ' ' || {_DBA} ELSE {_BARE} END")} AS name,
  regexp_replace(regexp_replace(lower(company_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM borrower_name"""


def type_normalise(spark: SparkSession, d: str) -> DataFrame:
    kind = names.normalise_type(F.col("investment_type"))
    return investments(spark, d).where("investment_type IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.first(names.is_debt(kind)).alias("is_debt"))


_KIND = S.trim("investment_type")
for _p in (r"\s*\(\$[0-9,]+\s*unfunded commitment\)", r"\s*\([a-z]{1,3}\)", r"(?i)\s*\([0-9,.]+\s*(?:LP\s+)?(?:units?|shares?)\)", r"(?i)\s*\(Units?\s+N/A\)"):
    _KIND = f"regexp_replace({_KIND}, '{_p}', '', 'g')"
TYPE_NORMALISE = f"SELECT kind, count(*) AS n, regexp_matches(lower(kind), 'lien|subordinated|mezzanine|revolving') AS is_debt FROM (SELECT {S.trim(_KIND)} AS kind FROM investment WHERE investment_type IS NOT NULL) GROUP BY kind"

CELLS = {
    "section": "array(concat(coalesce(investment_category, ''), ' Investments'), '', '')",
    "company": "array(coalesce(company_name, ''), coalesce(industry, ''), '')",
    "invest": "array(coalesce(investment_type, ''), '', coalesce(rate_spread_floor, ''), coalesce(rate_cash_pik, ''), coalesce(investment_date, ''), coalesce(maturity_date, ''), '$', coalesce(principal_amount, ''), '$', coalesce(cost, ''), '$', coalesce(fair_value, ''))",
    "total": "array('Total investments', '$', coalesce(fair_value, ''))",
    "subtotal": "array('', '', '$', coalesce(fair_value, ''))",
}


def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each investment as the rows that a filing would print of it."""
    shapes = F.array(*(F.struct(F.lit(k).alias("shape"), F.expr(v).alias("cells")) for k, v in CELLS.items()))
    return investments(spark, d).select("inv_id", F.explode(shapes).alias("x")).select("inv_id", "x.*")


def row_classify(spark: SparkSession, d: str) -> DataFrame:
    return printed_rows(spark, d).select("inv_id", "shape", cells.classify_row(F.col("cells")).alias("tag"))


def _sql_cells(v: str) -> str:
    return v.replace("array(", "[", 1)[:-1] + "]"


_ROWS = " UNION ALL ".join(f"SELECT inv_id, '{k}' AS shape, {_sql_cells(v)} AS cells FROM investment" for k, v in CELLS.items())
_AMT, _RATE, _DATE = "^[0-9,]+$", r"[0-9]+\.[0-9]+%\s*/\s*[0-9]+\.[0-9]+%", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
ROW_CLASSIFY = f"""WITH c AS ({_ROWS}), t AS (SELECT inv_id, shape, list_filter(list_transform(cells, lambda x: {S.trim('x')}), lambda y: y NOT IN ('', '$', '%')) AS ne, {S.trim('cells[1]')} AS first FROM c),
  u AS (SELECT *, lower(first) AS low, lower(array_to_string(ne, ' ')) AS joined FROM t)
  SELECT inv_id, shape, CASE WHEN len(ne) = 0 THEN 'EMPTY' WHEN joined LIKE '%portfolio company%' AND joined LIKE '%investment type%' THEN 'HEADER'
    WHEN (low LIKE '%affiliate investments%' OR low LIKE '%control investments%') AND low NOT LIKE '%total%' THEN 'SECTION' WHEN low LIKE 'total%' THEN 'TOTAL'
    WHEN regexp_matches(first, '(?i)({cells.KINDS})') THEN 'INVEST'
    WHEN first <> '' AND len(list_filter(ne, lambda x: regexp_matches(regexp_replace(x, '[,$]', '', 'g'), '{_AMT}'))) <= 1 AND len(ne) <= 3 AND
      ((len(ne) >= 2 AND NOT (regexp_matches(coalesce(ne[2], ''), '{_DATE}') OR regexp_matches(coalesce(ne[2], ''), '{_RATE}') OR regexp_matches(coalesce(ne[2], ''), '{_AMT}'))) OR (len(ne) = 1 AND NOT regexp_matches(replace(first, ',', ''), '{_AMT}'))) THEN 'COMPANY'
    WHEN first = '' AND len(list_filter(ne, lambda x: regexp_matches(x, '{_AMT}') OR regexp_matches(x, '^\\([0-9,]+$'))) > 0 THEN 'SUBTOTAL' ELSE 'UNKNOWN' END AS tag FROM u"""


def row_extract(spark: SparkSession, d: str) -> DataFrame:
    return printed_rows(spark, d).where("shape = 'invest'").select("inv_id", cells.extract_fields(F.col("cells")).alias("f")).select("inv_id", "f.*")


_SPREAD = r"\([SP]\+"
_OWN = f"NOT regexp_matches(x, '{_SPREAD}') AND NOT regexp_matches(x, '{_RATE}') AND NOT regexp_matches(x, '{_DATE}') AND (regexp_matches(x, '{_AMT}') OR x = '—')"
ROW_EXTRACT = f"""WITH c AS (SELECT inv_id, {_KIND} AS kind, list_transform({_sql_cells(CELLS['invest'])}[2:], lambda x: {S.trim('x')}) AS rest FROM (SELECT * REPLACE (coalesce(investment_type, '') AS investment_type) FROM investment)),
  e AS (SELECT inv_id, {S.trim('kind')} AS kind, list_filter(rest, lambda x: regexp_matches(x, '{_SPREAD}')) AS s, list_filter(rest, lambda x: regexp_matches(x, '{_RATE}') AND NOT regexp_matches(x, '{_SPREAD}')) AS r,
    list_filter(rest, lambda x: regexp_matches(x, '{_DATE}')) AS dt, list_transform(list_filter(rest, lambda x: {_OWN}), lambda x: CASE WHEN x = '—' THEN '' ELSE replace(x, ',', '') END) AS a FROM c),
  f AS (SELECT *, regexp_matches(lower(kind), 'lien|subordinated|mezzanine|revolving') AS debt FROM e)
  SELECT inv_id, kind AS investment_type, coalesce(s[-1], '') AS rate_spread_floor, coalesce(r[-1], '') AS rate_cash_pik, coalesce(dt[1], '') AS investment_date, coalesce(dt[2], '') AS maturity_date,
    CASE WHEN debt THEN coalesce(a[1], '') ELSE '' END AS principal_amount, CASE WHEN debt THEN coalesce(a[2], '') ELSE coalesce(a[1], '') END AS cost, CASE WHEN debt THEN coalesce(a[3], '') ELSE coalesce(a[2], '') END AS fair_value FROM f"""


FIXTURE = """<table><tr><td>Portfolio Company (a)(b)</td><td>Variable Index</td><td>Rate</td><td>Principal</td><td>Cost</td><td>Fair Value</td></tr><tr><td>Investment Type</td></tr>
<tr><td>Control Investments (t)</td></tr><tr><td>Acme Corp</td><td>Manufacturing</td></tr>
<tr><td>First Lien Debt</td><td>(S+7.75%) / (2.00%)</td><td>11.71%/0.50%</td><td>1/15/2024</td><td>1/15/2029</td><td>$</td><td>1,000</td><td>$</td><td>990</td><td>$</td><td>1,050</td></tr>
<tr><td>First Lien Debt</td><td>(S+7.50%) / (2.00%)</td><td>11.50%/0.50%</td><td>2/15/2024</td><td>1/15/2029</td><td>$</td><td>500</td><td>$</td><td>495</td><td>$</td><td>520</td></tr>
<tr><td>First Lien Debt</td><td>(S+8.00%) / (2.00%)</td><td>12.00%/0.50%</td><td>3/15/2024</td><td>1/15/2029</td><td>$</td><td>200</td><td>$</td><td>198</td><td>$</td><td>205</td></tr></table>"""


def schedule_fixture(spark: SparkSession, d: str) -> DataFrame:
    """A small filing from HTML to typed rows."""
    docs = spark.createDataFrame([("acme", FIXTURE)], "doc_id STRING, html STRING")
    return schedule.assemble(html.scan_tables(docs, ["doc_id"]))


_GOLDEN = [("11.71", "7.75", "1/15/2024", "1000", "990", "1050"), ("11.5", "7.5", "2/15/2024", "500", "495", "520"), ("12.0", "8.0", "3/15/2024", "200", "198", "205")]
SCHEDULE_FIXTURE = " UNION ALL ".join(
    f"""SELECT 'acme' AS doc_id, {i} AS row_no, 'Acme Corp' AS company_name, 'Manufacturing' AS industry, 'Control' AS investment_category, 'First Lien Debt' AS investment_type, '(S+{float(s):.2f}%) / (2.00%)' AS rate_spread_floor,
  '{float(c):.2f}%/0.50%' AS rate_cash_pik, '{at}' AS investment_date, '1/15/2029' AS maturity_date, '{p}' AS principal_amount, '{k}' AS cost, '{v}' AS fair_value, 'SOFR' AS rate_reference, '{s}' AS rate_spread_pct,
  '2.0' AS rate_floor_pct, '{c}' AS rate_cash_pct, '0.5' AS rate_pik_pct, 'regex' AS rate_parsed_by"""
    for i, (c, s, at, p, k, v) in enumerate(_GOLDEN, 1)
)


def newest_filing(spark: SparkSession, d: str) -> DataFrame:
    return files.newest_filing(table(spark, d, "filing"))


NEWEST_FILING = "SELECT ticker, filing_id, filed_at FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed_at DESC, filing_id DESC) AS rn FROM filing WHERE form = '10-K') WHERE rn = 1"


def first_load(spark: SparkSession, d: str) -> DataFrame:
    """Of rows loaded twice, the first load."""
    return quality.first_of(investments(spark, d), ["filing_id", "row_no"], ["loaded_at", "inv_id"]).select("filing_id", "row_no", "inv_id")


FIRST_LOAD = "SELECT filing_id, row_no, inv_id FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, row_no ORDER BY loaded_at NULLS FIRST, inv_id) AS rn FROM investment) WHERE rn = 1"

ALL = {
    "rank_topn": (rank_topn, RANK_TOPN), "top_companies": (top_companies, TOP_COMPANIES), "rank_runners_up": (rank_runners_up, RANK_RUNNERS_UP), "concentration": (concentration, CONCENTRATION),
    "breakdown_category": _breakdown("investment_category"), "breakdown_type": _breakdown("investment_type"), "breakdown_parsed_by": _breakdown("rate_parsed_by"), "reconciliation": (reconciliation, RECONCILIATION),
    "deep_dive": (deep_dive, DEEP_DIVE), "dq_report": (dq_report, DQ_REPORT), "dq_verdicts": (dq_verdicts, DQ_VERDICTS),
    "dq_blank": _rule("dq_blank", "BLANK_COMPANY", quality.blank_companies), "dq_name_is_category": _rule("dq_name_is_category", "COMPANY_IS_INDUSTRY", quality.companies_that_are_industries),
    "dq_runaway": _rule("dq_runaway", "RUNAWAY_COMPANY", quality.runaway_companies), "dq_multi_category": _rule("dq_multi_category", "COMPANY_MULTI_CATEGORY", quality.companies_of_many_categories),
    "dq_top_share": _rule("dq_top_share", "TOP_COMPANY_CONCENTRATED", quality.concentrated), "dq_blank_industry": _rule("dq_blank_industry", "BLANK_INDUSTRY", quality.blank_industries), "issue_counts": (issue_counts, ISSUE_COUNTS),
    "amount_clean": (amount_clean, AMOUNT_CLEAN), "rate_terms": (rate_terms, RATE_TERMS), "name_footnotes": (name_footnotes, NAME_FOOTNOTES), "type_normalise": (type_normalise, TYPE_NORMALISE),
    "row_classify": (row_classify, ROW_CLASSIFY), "row_extract": (row_extract, ROW_EXTRACT), "schedule_fixture": (schedule_fixture, SCHEDULE_FIXTURE), "newest_filing": (newest_filing, NEWEST_FILING), "first_load": (first_load, FIRST_LOAD),
}
