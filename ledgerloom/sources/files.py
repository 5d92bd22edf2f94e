"""Files that the engine reads and writes."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.badrows import SCHEDULE_COLUMNS

try:
    import yaml
except ImportError:  # only profiles need it
    yaml = None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html): each file as one document (SRC-04)."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("html"))
    return whole


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """A schedule file with every column as STRING (SRC-09)."""
    schema = ", ".join(f"`{c}` STRING" for c in SCHEDULE_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A website document (SRC-10)."""
    return spark.read.option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Rows with a header (SNK-01, SNK-02, SNK-05); columns says which and in what order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows, one document a line (SNK-03, SNK-04, SNK-06)."""
    df.write.mode("overwrite").json(path)


def pretty(row: DataFrame) -> str:
    """The single row of a document as indented JSON."""
    return row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).first()[0]


def cached(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """What make gives, written to path once and read from there afterwards (SRC-03)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if force or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest_filing(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The newest filing of a form for each ticker; ties go to the larger key (SRC-01)."""
    order = F.struct("filed_at", "filing_id")
    return filings.where(F.col("form") == form).groupBy("ticker").agg(F.max_by("filing_id", order).alias("filing_id"), F.max("filed_at").alias("filed_at"))


def parse_profile(text: str) -> dict[str, str | None]:
    """A profile in YAML (SRC-11): every value as text, leading zeros kept; no value is None."""
    if yaml is None:
        raise RuntimeError("profiles need the yaml package")
    loaded = yaml.load(text, Loader=yaml.BaseLoader) or {}
    return {str(k): str(v).strip() or None for k, v in loaded.items()}


def profiles(folder: str) -> dict[str, dict]:
    """All profiles of a folder by upper-case ticker, in order (SRC-12)."""
    return {p.stem.upper(): parse_profile(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.yaml"))}


def profile(spark: SparkSession, folder: str, ticker: str) -> DataFrame:
    """One row of a profile, in any case of its ticker; an unknown one raises and names those there are (JN-10)."""
    known = profiles(folder)
    if ticker.upper() not in known:
        raise ValueError(f"no profile for {ticker!r}; there are: {', '.join(known) or 'none'}")
    p = known[ticker.upper()]
    return spark.createDataFrame([(ticker.upper(), p.get("name"), p.get("cik"), p.get("notes"))], "ticker STRING, name STRING, cik STRING, notes STRING")


def setting(name: str, default: str | None = None, spark: SparkSession | None = None) -> str | None:
    """An environment variable, else a Spark setting under ledgerloom. (SRC-15)."""
    return os.environ.get(name) or (spark.conf.get(f"ledgerloom.{name.lower()}", default) if spark else default)


def slug_of(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def paths(raw: str, data: str, ticker: str = "", target: str = "") -> dict[str, str]:
    """Where each verb reads and writes (SNK-09)."""
    t, g = ticker.lower(), slug_of(target)
    return {
        "html": f"{raw}/{t}_10k_latest.html", "schedule": f"{data}/{t}_schedule_full.csv", "top": f"{data}/{t}_top10_by_fair_value.csv",
        "deepdive": f"{data}/{g}_filing_data.json", "website": f"{data}/{g}_website.json", "execs_csv": f"{data}/{g}_execs.csv", "execs_json": f"{data}/{g}_execs.json",
    }
