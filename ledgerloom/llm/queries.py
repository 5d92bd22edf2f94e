"""The queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import canonical, mainbody, mix, pieces, sentences, tokenize, variants
from ledgerloom.plans import sql as S
from ledgerloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.free_entries(table(spark, d, "investment"), table(spark, d, "canonical_value")).select("inv_id", "field_name", "value_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The entries that mean none of the list, with the number of rows that have them."""
    rows = canonical.free_entries(table(spark, d, "investment"), table(spark, d, "canonical_value")).where("value_id = 0")
    return rows.groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_lines(table(spark, d, "website_page"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_text(table(spark, d, "website_page"))


def _long_texts(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    """The pieces of filing_section and filing_chunk."""
    tables = {"filing_section": "section_id", "filing_chunk": "chunk_id"}
    both = [table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(k).alias("item_id"), "text") for t, k in tables.items()]
    return pieces.cut(both[0].unionByName(both[1]), ["table_name", "item_id"], with_text=with_text)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """An item is above the limit exactly if it has a second piece."""
    return _long_texts(spark, d, with_text=False).where("piece_no = 2").select("table_name", "item_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _long_texts(spark, d, with_text=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs_of(variants.organisations(table(spark, d, "borrower_name")))


def p5_organisations(spark: SparkSession, d: str) -> DataFrame:
    return variants.organisations(table(spark, d, "borrower_name"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mix.unreachable(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares actually reached, counted from the rows of the mix."""
    rows, planned = mix.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"), (F.max("copy_no") + 1).alias("most_repeats"))
    out = planned.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_repeats"])
    return out.withColumn("mixed_share", F.round(F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy()), 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_text, p3_found, p3_pieces, p5_found, p5_organisations, p6_ids, p7_found, p7_mix, p7_report, p8_found)}


def oracle_sql() -> dict[str, str]:
    long = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS item_id FROM {t} WHERE len({S.words('text')}) > 512" for t, k in (("filing_section", "section_id"), ("filing_chunk", "chunk_id")))
    return {"p3_found": long}
