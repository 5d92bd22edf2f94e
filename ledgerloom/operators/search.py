"""Vector search over chunks, and answers that cite them or refuse."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.session import spread

#: Fixed value: what an answer says without a source.
REFUSAL = "I can't answer that from the %s 10-K — retrieval returned no relevant passages. (No grounded source, so I won't guess.)"
#: The rules that a model is given with the sources.
SYSTEM = (
    "Work only with the passages below; each has a number. Put the number of the passage in square brackets, such as [2], behind every statement that rests on it. "
    "Where the passages do not answer the question, say that and stop. Add nothing that you know from elsewhere."
)
DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; of unit vectors it is their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of lower-case words by hashed bucket, at unit length: the embedding where there is no model (VEC-01).

    Words are hashed by built-in expressions; only their buckets go through Arrow, to be counted once.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
    buckets = F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint"), F.lit(dimensions)))


    @F.pandas_udf("array<double>")
    def unit_counts(batch: pd.Series) -> pd.Series:
        out = []
        for b in batch:
            counts = np.bincount(np.asarray(b, np.int64), minlength=dimensions).astype(float)
            norm = np.sqrt((counts * counts).sum())
            out.append(counts / norm if norm else counts)
        return pd.Series(out)

    return unit_counts(buckets)


def index(chunks: DataFrame, text: str = "text", embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """chunks and their vectors (VEC-02, SNK-07); write it where several searches read it. A table without a row raises."""
    if chunks.isEmpty():
        raise ValueError("there is nothing to index")
    return spread(chunks).withColumn("vector", embed(F.col(text)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "vector", query: str = "query_id", query_vector: str = "query_vector", min_score: float | None = None, most_queries: int = 1000) -> DataFrame:
    """(query, key, score, rank): the k nearest of all vectors for each query (VEC-03, JN-04, TOP-04), exactly.

    Queries are a stated set of at most most_queries, else it raises. They are held by each task as one array, the scores of a row
    go to the k best of its partition first, and only those are ranked. Ties go to the smaller key; without min_score there is no
    least score.
    """
    own = queries.select(F.col(query).alias("q"), F.col(query_vector).alias("v")).limit(most_queries + 1)
    packed = own.agg(F.collect_list(F.struct("q", "v")).alias("__qs"))
    checked = packed.withColumn("__qs", F.when(F.size("__qs") > most_queries, F.raise_error("too many queries for one search")).otherwise(F.col("__qs")))
    scored = vectors.select(F.col(key).alias("k"), F.col(vector).alias("x")).where("x IS NOT NULL").join(F.broadcast(checked)).select("k", F.explode(F.transform("__qs", lambda e: F.struct(e["q"].alias("q"), dot(F.col("x"), e["v"]).alias("score")))).alias("s")).select("k", "s.q", "s.score")
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    # k best of salted parts, then of the parts together: no task sorts all scores of a query
    salted = scored.withColumn("__salt", F.pmod(F.xxhash64("k"), F.lit(64)))
    some = _k_best(salted, ["q", "__salt"], k).drop("rank", "__salt")
    return _k_best(some, ["q"], k).select(F.col("q").alias(query), F.col("k").alias(key), "score", "rank")


def _k_best(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("k")))
    return scored.withColumn("rank", at).where(F.col("rank") <= k)


def retrieve(indexed: DataFrame, question: str, k: int = 10, key: str = "chunk_id", embed: Callable[[Column], Column] = hashed_embedding, min_score: float | None = None, prefix: bool = False) -> DataFrame:
    """indexed rows with score and rank, the k nearest to a question (VEC-05)."""
    spark = indexed.sparkSession
    asked = spark.createDataFrame([(0, T.query_text(question) if prefix else question)], "query_id INT, q STRING").select("query_id", embed(F.col("q")).alias("query_vector"))
    best = nearest(indexed, asked, k, key, min_score=min_score).drop("query_id")
    return indexed.join(F.broadcast(best), key)  # k rows


def answer(found: DataFrame, question: str, ticker: str, model: Callable[[str], str] | None = None) -> DataFrame:
    """One row: text, question, ticker, refused, llm_used, citations (UDF-04, FN-17 to FN-21).

    found: rank, text and citation of each chunk. Without a chunk it refuses and asks no model; without a model it quotes.
    """
    spark = found.sparkSession
    all_ = found.agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))).alias("c"))
    cited = F.transform("c", lambda x, i: F.format_string("[%d] %s", i + 1, x["citation"]))
    sources = F.concat(F.lit("Sources:\n"), F.array_join(cited, "\n"))
    quoted = F.concat(F.format_string("[no-LLM mode] Top grounded passage for %s:\n%s [1]\n\n", F.lit(ticker.upper()), T.preview(F.get("c", F.lit(0))["text"])), sources)
    empty = F.size("c") == 0
    base = all_.select(
        F.when(empty, F.format_string(REFUSAL, F.lit(ticker.upper()))).otherwise(quoted).alias("text"), F.lit(question).alias("question"), F.lit(ticker.upper()).alias("ticker"),
        empty.alias("refused"), F.lit(False).alias("llm_used"), F.transform("c", lambda x: x["citation"]).alias("citations"), sources.alias("__sources"), prompt(F.col("c"), question).alias("__prompt"),
    )
    if model is None:
        return base.drop("__sources", "__prompt")
    row = base.first()
    if row["refused"]:
        return base.drop("__sources", "__prompt")
    said = f"{model(row['__prompt'])}\n\n{row['__sources']}"
    return spark.createDataFrame([(said, question, ticker.upper(), False, True, row["citations"])], "text STRING, question STRING, ticker STRING, refused BOOLEAN, llm_used BOOLEAN, citations ARRAY<STRING>")


def prompt(chunks: Column, question: str) -> Column:
    """What a model is asked: rules, numbered sources, the question (FN-19)."""
    blocks = F.array_join(F.transform(chunks, lambda x, i: F.format_string("[%d] %s\n%s", i + 1, x["citation"], x["text"])), "\n\n")
    return F.concat(F.lit(f"{SYSTEM}\n\n=== SOURCES ===\n"), blocks, F.lit(f"\n\n=== QUESTION ===\n{question}\n\nAnswer, citing sources with [n]:"))


