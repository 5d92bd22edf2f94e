"""Pieces of SQL that several comparison queries share."""

SPACE = r"[\t-\r\p{Z}\x{85}]+"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g')"


def amount_text(c: str) -> str:
    bare = f"trim(replace(replace({c}, '$', ''), ',', ''))"
    return f"CASE WHEN {c} IS NULL OR {c} IN ('', '—') THEN '' WHEN {bare} LIKE '(%' AND {bare} LIKE '%)' THEN '-' || substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"


def amount(c: str) -> str:
    return f"TRY_CAST(NULLIF({amount_text(c)}, '') AS DECIMAL(38,2))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{SPACE}'), lambda w: w <> '')"


def extracted(c: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({c}, '{pattern}', {group}), '')"


def number(c: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST({extracted(c, pattern, group)} AS DOUBLE)"
