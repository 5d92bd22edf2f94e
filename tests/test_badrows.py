"""Problem 4 against a record parser that reads one character after the other."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import badrows as B


def fields_of(text):
    """The fields of a record, or None where quoting is broken."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            j, value = i + 1, ""
            while True:
                if j >= n:
                    return None
                if text[j] == '"' and text[j + 1 : j + 2] == '"':
                    value, j = value + '"', j + 2
                elif text[j] == '"':
                    j += 1
                    break
                else:
                    value, j = value + text[j], j + 1
            if j < n and text[j] != ",":
                return None
        else:
            j = text.find(",", i) if "," in text[i:] else n
            value = text[i:j]
            if '"' in value:
                return None
        out.append(value)
        if j >= n:
            return out
        i = j + 1


GOOD = ["Acme, Inc.", "Pet Care", "Control", "First Lien Debt", "", "", "1/2/2020", "—", "1,000", " $2 ", "(3.5)", "", "", "", "", "", "regex"]


def line(values):
    return ",".join('"' + v.replace('"', '""') + '"' if "," in v or '"' in v or "\n" in v else v for v in values)


def schedule(**changes):
    return line([changes.get(c, g) for c, g in zip(B.SCHEDULE_COLUMNS, GOOD)])


CASES = [
    ("schedule", schedule(), None),
    ("schedule", schedule(company_name='A "B"\nC, D'), None),
    ("schedule", schedule() + ",x", "column_count"),
    ("schedule", "", "column_count"),
    ("schedule", '"open,' + schedule(), "broken_quoting"),
    ("schedule", schedule(industry='x"y').replace('"x""y"', 'x"y'), "broken_quoting"),
    ("schedule", schedule(fair_value="12k"), "invalid_value"),
    ("schedule", schedule(cost="(5"), "invalid_value"),
    ("schedule", schedule(cost="--"), None),
    ("schedule", schedule(principal_amount="-$1,234.50"), None),
    ("schedule", schedule(investment_date="2/29/2023"), "invalid_value"),
    ("schedule", schedule(investment_date="2/29/2024"), None),
    ("schedule", schedule(maturity_date="6/7/23"), "invalid_value"),
    ("issue", "error,BLANK_COMPANY,x,1;2", None),
    ("issue", "error,BLANK_COMPANY,,", None),
    ("issue", "error,BLANK_COMPANY,,0", "invalid_value"),
    ("issue", "fatal,BLANK_COMPANY,,", "invalid_value"),
    ("issue", "error,blank_company,,", "invalid_value"),
    ("issue", "error,BLANK_COMPANY,x", "column_count"),
    ("issue", None, "column_count"),
    (None, "error,BLANK_COMPANY,x,1", "column_count"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, f, t, "kept") for i, (f, t, _) in enumerate(CASES)], "record_id LONG, feed STRING, raw_text STRING, level STRING")
    got = {r["record_id"]: r["reason"] for r in B.classify(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]
    row = B.schedule_rows(df).where("record_id = 0").first()
    assert row["company_name"] == "Acme, Inc." and float(row["fair_value_value"]) == -3.5 and row["investment_date_value"] == datetime.date(2020, 1, 2)
    assert row["maturity_date_value"] is None
    issues = {r["record_id"]: r["rows"] for r in B.issue_rows(df).collect()}
    assert issues[13] == [1, 2] and issues[14] == []


def test_quoting_and_count_like_a_parser(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('",a \n') for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, "issue", t) for i, t in enumerate(texts)], "record_id LONG, feed STRING, raw_text STRING")
    got = {r["record_id"]: r["reason"] for r in B.classify(df).collect()}
    for i, t in enumerate(texts):
        fields = fields_of(t)
        want = "broken_quoting" if fields is None else "column_count" if len(fields) != 4 else "invalid_value"
        assert got[i] == want, t


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "schedule", schedule(company_name="x" * 300_000)), (2, "schedule", '"' * 200_001)], "record_id LONG, feed STRING, raw_text STRING")
    assert {r["record_id"]: r["reason"] for r in B.classify(df).collect()} == {1: None, 2: "broken_quoting"}
    assert B.classify(df.where(F.lit(False))).count() == 0


def test_values_beyond_their_types_load_and_are_named(spark):
    many = "9" * 40
    df = spark.createDataFrame([(1, "issue", "error,BLANK_COMPANY,msg,7;99999999999;" + many), (2, "schedule", schedule(cost="$" + many, fair_value="8" * 32))], "record_id LONG, feed STRING, raw_text STRING")
    assert [r["reason"] for r in B.classify(df).collect()] == [None, None]
    issue = B.issue_rows(df).first()
    assert issue["rows"] == [7, 99999999999, None] and issue["rows_text"].endswith(many)
    row = B.schedule_rows(df).first()
    assert row["too_large"] == "cost" and row["cost"] == "$" + many and row["cost_value"] is None and row["fair_value_value"] is not None


def test_line_break_in_an_unquoted_field_and_many_columns(spark):
    df = spark.createDataFrame([(1, "issue", "error,BLANK_COMPANY,two\nlines,5"), (2, "issue", "x," * 30_000), (4, "issue", 'x",' * 30_000), (5, "issue", 'error,BLANK_COMPANY,"' + "," * 30_000 + '",'), (3, "schedule", schedule(company_name="a\r\nb", principal_amount="5").replace('"', "").replace("Acme, Inc.", ""))], "record_id LONG, feed STRING, raw_text STRING")
    assert {r["record_id"]: r["reason"] for r in B.classify(df).collect()} == {1: None, 2: "column_count", 3: None, 4: "broken_quoting", 5: None}
    assert B.issue_rows(df).where("record_id = 1").first()["message"] == "two\nlines" and B.schedule_rows(df).first()["company_name"] == "a\r\nb"


@pytest.mark.parametrize("text,value", [("1,234", 1234), ("($5.5)", -5.5), ("-7", -7), ("—", None), ("", None), ("x", None)])
def test_amount(spark, text, value):
    got = spark.createDataFrame([(text,)], "t STRING").select(B.amount(F.col("t"))).first()[0]
    assert (None if got is None else float(got)) == value
