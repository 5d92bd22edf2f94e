"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import badrows
from ledgerloom.plans import sql as S
from ledgerloom.plans import relational_queries, schedule_queries, site_queries, text_queries
from ledgerloom.session import table


PARTS = [schedule_queries.ALL, text_queries.ALL, relational_queries.ALL, site_queries.ALL]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(table(spark, d, "raw_record")).select("record_id", "reason")


_T = S.trim("v")
_NONE = "('', '-', '--', '—')"
_VALUES = "list_transform(regexp_extract_all(raw_text, '(?s)(?:^|,)(\"(?:[^\"]|\"\")*\"|[^,]*)', 1), lambda f: CASE WHEN f LIKE '\"%' THEN replace(substr(f, 2, length(f) - 2), '\"\"', '\"') ELSE f END)"
_BAD_AMOUNTS = f"len(list_filter(v[9:11], lambda v: {_T} NOT IN {_NONE} AND NOT regexp_full_match({_T}, '{badrows.AMOUNT.strip('^$')}'))) > 0"
_BAD_DATES = f"len(list_filter(v[7:8], lambda v: {_T} NOT IN {_NONE} AND NOT (regexp_full_match({_T}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AND try_strptime({_T}, '%m/%d/%Y') IS NOT NULL))) > 0"
_SORTED = f"""WITH m AS (SELECT record_id, feed, raw_text, string_split(regexp_replace(replace(raw_text, chr(1), ' '), '"[^"]*"', chr(1), 'g'), ',') AS f FROM raw_record),
  c AS (SELECT *, CASE WHEN raw_text IS NULL THEN 'column_count' WHEN len(list_filter(f, lambda x: contains(x, '"') OR (contains(x, chr(1)) AND replace(x, chr(1), '') <> ''))) > 0 THEN 'broken_quoting'
    WHEN len(f) <> CASE feed WHEN 'schedule' THEN 17 WHEN 'issue' THEN 4 ELSE -1 END THEN 'column_count' END AS r, {_VALUES} AS v FROM m),
  w AS (SELECT record_id, feed, v, coalesce(r, CASE WHEN feed = 'schedule' AND ({_BAD_AMOUNTS} OR {_BAD_DATES}) THEN 'invalid_value'
    WHEN feed = 'issue' AND (v[1] NOT IN {tuple(badrows.ISSUE_LEVELS)} OR v[2] NOT IN {tuple(badrows.ISSUE_CODES)} OR NOT regexp_full_match(v[4], '(?:0*[1-9][0-9]*(?:;0*[1-9][0-9]*)*)?')) THEN 'invalid_value' END) AS reason FROM c)"""
P4_FOUND = f"{_SORTED} SELECT record_id, reason FROM w WHERE reason IS NOT NULL"


def _p4_schedule_sql() -> str:
    """The valid schedule records with their amounts and dates."""
    columns = [f"NULLIF(v[{i}], '') AS {c}" for i, c in enumerate(badrows.SCHEDULE_COLUMNS, 1)]
    at, values, large = {c: i for i, c in enumerate(badrows.SCHEDULE_COLUMNS, 1)}, [], []
    for c in badrows.AMOUNTS:
        t = S.trim(f"v[{at[c]}]")
        bare = f"TRY_CAST(regexp_replace({t}, '[$,()-]', '', 'g') AS DECIMAL(38,6))"
        values.append(f"CASE WHEN {t} NOT IN {_NONE} THEN CASE WHEN regexp_matches({t}, '[-(]') THEN -{bare} ELSE {bare} END END AS {c}_value")
        large.append(f"CASE WHEN {t} NOT IN {_NONE} AND {bare} IS NULL THEN '{c}' END")
    for c in badrows.DATES:
        values.append(f"try_strptime({S.trim(f'v[{at[c]}]')}, '%m/%d/%Y')::DATE AS {c}_value")
    return f"{_SORTED} SELECT record_id, {', '.join(columns + values)}, concat_ws(';', {', '.join(large)}) AS too_large FROM w WHERE reason IS NULL AND feed = 'schedule'"


P4_ISSUES = f"""{_SORTED} SELECT record_id, v[1] AS level, v[2] AS code, NULLIF(v[3], '') AS message, coalesce(v[4], '') AS rows_text,
  list_transform(list_filter(string_split(coalesce(v[4], ''), ';'), lambda n: n <> ''), lambda n: TRY_CAST(n AS BIGINT)) AS rows FROM w WHERE reason IS NULL AND feed = 'issue'"""


def p4_schedule(spark: SparkSession, d: str) -> DataFrame:
    return badrows.schedule_rows(table(spark, d, "raw_record"))


def p4_issues(spark: SparkSession, d: str) -> DataFrame:
    return badrows.issue_rows(table(spark, d, "raw_record"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return schedule_queries.rank_topn(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p4_found, p4_schedule, p4_issues)}
    return own | {name: f for part in PARTS for name, (f, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    own = {"p4_found": P4_FOUND, "p4_schedule": _p4_schedule_sql(), "p4_issues": P4_ISSUES}
    return own | {name: sql for part in PARTS for name, (_, sql) in part.items() if sql}
