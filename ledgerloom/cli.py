"""The verbs of the command line: thin compositions of operators over files.

python -m ledgerloom.cli VERB ...; see --help. Exit code 1 tells a missing input, no schedule or failed rules.
"""

from __future__ import annotations

import argparse
import shutil
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import __version__
from ledgerloom.functions import text as T
from ledgerloom.operators import analytics, corpus, mentions, quality, schedule, search, site
from ledgerloom.session import local_session
from ledgerloom.sources import files, html


class Failed(Exception):
    """What ends a verb with exit code 1."""


def document(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).exists():
        raise Failed(f"{path} is not there; fetch it first")
    return files.read_documents(spark, path)


def fetch(ticker: str, source: str, raw: str, force: bool = False) -> str:
    """The newest filing of a ticker put into the cache, from local files: the folder's last TICKER*.html by name (SRC-02, SRC-03)."""
    to = files.paths(raw, "", ticker)["html"]
    if Path(to).exists() and not force:
        return to
    found = sorted(Path(source).glob(f"{ticker.lower()}*.html"))
    if not found:
        raise Failed(f"no file for {ticker} in {source}")
    Path(raw).mkdir(parents=True, exist_ok=True)
    shutil.copyfile(found[-1], to)
    return to


def locate(spark: SparkSession, path: str) -> list[dict]:
    """Diagnostics of each group of schedule tables."""
    rows = html.scan_tables(document(spark, path), ["doc_id"]).persist()
    tables = schedule.islands(schedule.table_signs(rows))
    return [r.asDict(recursive=True) for r in schedule.diagnostics(rows, tables).orderBy("group_no").collect()]


def make_schedule(spark: SparkSession, path: str, out: str, allow_failure: bool = False) -> list[dict]:
    """Schedule rows to CSV, and the issues found; errors end it unless they are allowed (VAL-8)."""
    rows = html.scan_tables(document(spark, path), ["doc_id"]).persist()
    done = schedule.assemble(rows).persist()
    if done.isEmpty():
        raise Failed("no schedule found")
    files.write_csv(done.coalesce(1).sortWithinPartitions("row_no"), out, files.SCHEDULE_COLUMNS)
    inside = rows.join(schedule.islands(schedule.table_signs(rows)).where("group_no = 1").select("doc_id", "table_idx"), ["doc_id", "table_idx"], "left_semi")
    found = quality.report(done, ["doc_id"], unknown=schedule.unknown_rows(inside))
    issues = [r.asDict() for r in found.orderBy("rule_no").collect()]
    if any(i["level"] == "error" for i in issues) and not allow_failure:
        raise Failed("\n".join(f"{i['level']} {i['code']}: {i['message']}" for i in issues))
    return issues


def rank(spark: SparkSession, path: str, out: str, n: int = 10) -> list[dict]:
    """The n largest companies to CSV."""
    rows = files.read_schedule(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    best = analytics.top(analytics.company_totals(rows, [], exact=True), n).orderBy("rank")
    columns = ["rank", "company_name", "industry", "investment_category", "total_fair_value", "total_cost", "num_investments", "investment_types"]
    files.write_csv(best.coalesce(1), out, columns)
    return [r.asDict() for r in best.select(columns).collect()]


def deepdive(spark: SparkSession, schedule_path: str, html_path: str, target: str, out: str) -> str:
    """One document on a company: its rows, its sums and its mentions elsewhere in the filing."""
    rows = files.read_schedule(spark, schedule_path).withColumn("row_no", F.monotonically_increasing_id())
    found = analytics.deep_dive(rows, target, ["row_no"])
    if found.isEmpty():
        raise Failed(f"no company matches {target!r}")
    text = html.scan_text(document(spark, html_path), ["doc_id"], sep=" ")
    said = mentions.outside_schedule(mentions.mentions(text, target, ["doc_id"])).agg(F.array_sort(F.collect_list(F.struct("position", "likely_section", "snippet"))).alias("other_filing_mentions"))
    whole = found.join(said)  # one row each
    files.write_json(whole, out)
    return files.pretty(whole)


def website(spark: SparkSession, pages: DataFrame, company: str, out: str) -> DataFrame:
    """A site's pages, leaders and products as one document. pages: url, base_url, type, status_code, html."""
    table = site.page_table(pages, ["url"])
    listed = table.agg(F.array_sort(F.collect_list(F.struct("url", "status_code", "clean_text", "emails", "phones", "error"))).alias("pages"))
    people = site.leaders(pages.withColumn("site", F.lit(company)), ["site", "url"], ["site"])
    led = people.agg(F.array_sort(F.collect_list(F.struct("url", "ord", "name", "title", "bio"))).alias("leadership"))
    made = site.products(pages.where("type = 'products'"), ["url"]).agg(F.array_distinct(F.flatten(F.collect_list("products"))).alias("products"))
    whole = listed.join(led).join(made).withColumn("company_name", F.lit(company))  # one row each
    files.write_json(whole, out)
    return whole


def execs(spark: SparkSession, path: str, out: str, n: int = 3) -> list[dict]:
    """The n most senior leaders of a site's document to CSV."""
    people = files.read_json(spark, path).select(F.explode("leadership").alias("p")).select("p.*")
    best = site.executives(people, n, ["url", "ord"])
    files.write_csv(best.coalesce(1), out, ["rank", "name", "title", "source_url", "linkedin_status", "linkedin_notes"])
    return [r.asDict() for r in best.orderBy("rank").collect()]


def ask(spark: SparkSession, path: str, ticker: str, question: str, k: int = 10, model: Callable[[str], str] | None = None, min_score: float | None = None) -> dict:
    """An answer from a filing's chunks, cited, or a refusal."""
    docs = document(spark, path).persist()
    drop = schedule.groups(schedule.islands(schedule.table_signs(html.scan_tables(docs, ["doc_id"])))).groupBy("doc_id").agg(F.flatten(F.collect_list("tables")).alias("drop"))
    text = html.scan_text(docs.join(drop, "doc_id", "left"), ["doc_id"], drop="drop")
    parts = corpus.chunks(corpus.sections(text), ["doc_id", "item", "title"], drop_noise=True).withColumn("chunk_id", F.concat_ws("-", "item", "chunk_no"))
    found = search.retrieve(search.index(parts), question, k, min_score=min_score)
    cited = found.select("rank", "text", T.cite(F.col("doc_id"), F.col("item"), F.col("title"), F.col("char_start"), F.col("char_end")).alias("citation"))
    return search.answer(cited, question, ticker, model).first().asDict()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--raw", default="raw")
    p.add_argument("--data", default="data")
    p.add_argument("--profiles", default="profiles")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("profiles")
    for name in ("fetch", "locate", "schedule", "rank", "deepdive"):
        v = verbs.add_parser(name)
        v.add_argument("ticker")
        if name == "fetch":
            v.add_argument("--source", default="filings")
            v.add_argument("--force", action="store_true")
        if name == "schedule":
            v.add_argument("--allow-validation-failure", action="store_true")
        if name == "rank":
            v.add_argument("--top", type=int, default=10)
        if name == "deepdive":
            v.add_argument("--target", required=True)
    v = verbs.add_parser("website")
    v.add_argument("--target", required=True)
    v.add_argument("--pages", required=True, help="Parquet of url, base_url, type, status_code, html")
    v = verbs.add_parser("execs")
    v.add_argument("--target", required=True)
    v.add_argument("--top", type=int, default=3)
    v = verbs.add_parser("ask")
    v.add_argument("question")
    v.add_argument("--ticker", required=True)
    v.add_argument("--k", type=int, default=10)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    where = files.paths(a.raw, a.data, getattr(a, "ticker", ""), getattr(a, "target", ""))
    if a.verb == "profiles":
        print(*files.profiles(a.profiles), sep="\n")
        return 0
    try:
        if a.verb == "fetch":
            print(fetch(a.ticker, a.source, a.raw, a.force))
            return 0
        spark = spark or local_session("ledgerloom")
        if a.verb == "locate":
            out = locate(spark, where["html"]) if Path(where["html"]).exists() else []
        elif a.verb == "schedule":
            out = make_schedule(spark, where["html"], where["schedule"], a.allow_validation_failure)
        elif a.verb == "rank":
            out = rank(spark, where["schedule"], where["top"], a.top)
        elif a.verb == "deepdive":
            out = [deepdive(spark, where["schedule"], where["html"], a.target, where["deepdive"])]
        elif a.verb == "website":
            out = website(spark, spark.read.parquet(a.pages), a.target, where["website"]).collect()
        elif a.verb == "execs":
            out = execs(spark, where["website"], where["execs_csv"], a.top)
        else:
            out = [ask(spark, where["html"], a.ticker, a.question, a.k)["text"]]
        print(*out, sep="\n")
        return 0
    except Failed as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
