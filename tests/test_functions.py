"""Column functions against known cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, cells, names, rates, text, titles, urls


def one(spark, make, *values):
    columns = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} STRING" for c in columns))
    return df.select(make(*(F.col(c) for c in columns)).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("1,234", "1234"), ("$1,234", "1234"), ("(14)", "-14"), ("—", ""), ("", ""), (None, "")])
def test_clean_amount(spark, raw, want):
    assert one(spark, amounts.clean_amount, raw) == want


@pytest.mark.parametrize("name,want", [("Acme (a)", "Acme"), ("Acme (h)(j)", "Acme"), ("Acme (fka Old Co)", "Acme"), ("Acme (dba Best)", "Acme (dba Best)"), ("Acme (ab) LLC", "Acme LLC"), ("Acme", "Acme")])
def test_footnotes(spark, name, want):
    assert one(spark, names.strip_footnotes, name) == want


@pytest.mark.parametrize("kind,want", [("Common Equity (1,000 units) (k)", "Common Equity"), ("Revolving Loan ($1,500 unfunded commitment) (j)", "Revolving Loan"), ("Warrants (Units N/A)", "Warrants"), ("Preferred (9.5 LP units)", "Preferred")])
def test_types(spark, kind, want):
    assert one(spark, names.normalise_type, kind) == want


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("(S+7.75%) / (2.00%)", "11.71%/0.50%", ("SOFR", 7.75, 2.0, 11.71, 0.5, "regex")),
        ("(P+5.00%) / (1.50%)", "", ("Prime", 5.0, 1.5, None, None, "regex")),
        ("(S+6.50%)", "10.00%/0.00%", ("SOFR", 6.5, None, 10.0, 0.0, "regex")),
        ("", "11.00%", (None, None, None, 11.0, None, "regex")),
        ("SOFR + 5.00%, 2.00% floor", "", ("SOFR", 5.0, 2.0, None, None, "regex")),
        ("variable", "", (None, None, None, None, None, "regex")),
        ("—", "-", (None, None, None, None, None, "none")),
        ("", "8.00% cash, 2.00% PIK", (None, None, None, 8.0, 2.0, "regex")),
        (None, None, (None, None, None, None, None, "none")),
    ],
)
def test_rates(spark, a, b, want):
    r = one(spark, rates.parse_rate, a, b)
    assert (r["reference"], r["spread_pct"], r["floor_pct"], r["cash_pct"], r["pik_pct"], r["parsed_by"]) == want


@pytest.mark.parametrize(
    "row,tag",
    [
        (["", "", ""], "EMPTY"), (["Portfolio Company", "Investment Type"], "HEADER"), (["Control Investments (t)"], "SECTION"), (["Total Control Investments", "1"], "TOTAL"), (["First Lien Debt (k)", "x"], "INVEST"),
        (["Acme Corp", "Manufacturing"], "COMPANY"), (["", "", "1,234"], "SUBTOTAL"), (["Portfolio Company (a)(b)", "Variable Index", "Rate", "Spread"], "UNKNOWN"),
    ],
)
def test_rows(spark, row, tag):
    assert spark.createDataFrame([(row,)], "c ARRAY<STRING>").select(cells.classify_row(F.col("c"))).first()[0] == tag


@pytest.mark.parametrize(
    "row,want",
    [
        (["First Lien Debt", "(S+7.75%) / (2.00%)", "11.71%/0.50%", "1/15/2024", "1/15/2029", "$", "1,000", "$", "990", "$", "1,050"], ("1000", "990", "1050")),
        (["Common Equity (100 units)", "1/15/2024", "500", "—"], ("", "500", "")),
        (["Common Equity", "500", "(14", ")"], ("", "500", "-14")),
        (["Common Equity", "500", "(14"], ("", "500", "")),
        (["First Lien Debt", "(14)", "9"], ("9", "", "")),
    ],
)
def test_fields(spark, row, want):
    f = spark.createDataFrame([(row,)], "c ARRAY<STRING>").select(cells.extract_fields(F.col("c")).alias("f")).first()["f"]
    assert (f["principal_amount"], f["cost"], f["fair_value"]) == want


@pytest.mark.parametrize("title,tier", [("Chief Executive Officer", 1), ("EVP Sales", 9), ("Senior Vice President", 10), ("Vice President, Ops", 11), ("Director", 4), ("General Manager", 99), ("VP, Sales", 99), ("Coordinator", 3)])
def test_titles(spark, title, tier):
    assert one(spark, titles.rank_title, title) == tier


def test_text(spark):
    assert one(spark, text.word_count, "a\xa0b  c") == 3
    assert one(spark, text.word_count, None) == 0
    assert one(spark, text.prose_fraction, "a b 1") == pytest.approx(2 / 3)
    assert one(spark, lambda c: text.preview(c, 3), " ab\ncd") == "ab …"
    assert one(spark, text.item_header, "  item 1a. Risk Factors") == "1A"
    assert one(spark, text.item_title, "Item 1A. Risk Factors.") == "Risk Factors."


def test_urls(spark):
    assert one(spark, lambda u: urls.page_type(u, F.lit("https://a.example/"), F.lit("Our Team")), "https://a.example/x") == "about"
    assert one(spark, urls.with_slash, "https://a.example//") == "https://a.example/"
    assert one(spark, lambda t: urls.contacts(t, urls.EMAIL), "write b@x.example or a@x.example, a@x.example") == ["a@x.example", "b@x.example"]
    pages = one(spark, urls.product_pages, " https://a.example/p/one/ ,,https://b.example")
    assert [(p["url"], p["label"]) for p in pages] == [("https://a.example/p/one/", "one"), ("https://b.example", "https://b.example")]


def test_slug_and_highlight(spark):
    assert one(spark, names.slug, " Ärger & Co. 7 ") == "rger_co_7"
    assert one(spark, lambda c: names.highlight(c, "acme."), "See ACME. now") == "See >>> ACME. <<< now"
