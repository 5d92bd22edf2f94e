"""The verbs from a filing to an answer."""

from ledgerloom import cli
from ledgerloom.plans.schedule_queries import FIXTURE

LONG = " ".join(["The company lends to small firms and watches its risk with care."] * 60)


def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    filing = f"<html><body><p>Annual report</p><p>Item 1. Business.</p><p>{LONG}</p><p>Item 1A. Risk Factors.</p><p>Acme Corp may fail to pay, which is a risk.</p>{FIXTURE}</body></html>"
    (tmp_path / "in" / "abc-2024.html").write_text(filing)
    base = ["--raw", str(tmp_path / "raw"), "--data", str(tmp_path / "data")]
    run = lambda *a: cli.main([*base, *a], spark)
    assert run("schedule", "abc") == 1
    assert run("fetch", "ABC", "--source", str(tmp_path / "in")) == 0
    assert run("fetch", "zz", "--source", str(tmp_path / "in")) == 1
    assert run("locate", "abc") == 0 and "Control Investments" in capsys.readouterr().out
    assert run("schedule", "abc") == 0
    assert "UNKNOWN_ROWS_PRESENT" in capsys.readouterr().out
    assert run("rank", "abc") == 0 and "1775.0" in capsys.readouterr().out
    assert run("deepdive", "abc", "--target", "acme") == 0
    assert "may fail to pay" in capsys.readouterr().out
    assert run("deepdive", "abc", "--target", "nobody") == 1
    assert run("ask", "What does the company lend?", "--ticker", "abc", "--k", "2") == 0
    said = capsys.readouterr().out
    assert "Item 1 (Business.)" in said and "Variable Index" not in said


def test_site_verbs(spark, tmp_path):
    page = '<body><div class="team"><h3>Ann Lee</h3><p>President</p></div><main>Call 555-123-4567</main></body>'
    spark.createDataFrame([("https://a.example/", "https://a.example", "about", 200, page)], "url STRING, base_url STRING, type STRING, status_code INT, html STRING").write.parquet(str(tmp_path / "p"))
    base = ["--data", str(tmp_path / "data")]
    assert cli.main([*base, "website", "--target", "A Co", "--pages", str(tmp_path / "p")], spark) == 0
    assert cli.main([*base, "execs", "--target", "A Co"], spark) == 0
    assert "Ann Lee" in "".join(p.read_text() for p in (tmp_path / "data" / "a_co_execs.csv").glob("*.csv"))
