import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mix as M


def test_splitting_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([10, 0, 301, 7])
    shards = M.split(counts, 7, rng)
    assert shards.shape == (7, 4) and (shards.sum(0) == counts).all() and shards.sum(1).max() - shards.sum(1).min() <= 7


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "big", "word " * 9) for i in range(300)] + [(1000 + i, "small", "a b c") for i in range(5)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "big", None), (2003, "small", "")]
    targets = [("big", 0.5, 2), ("small", 0.4, 3), ("gone", 0.1, 4)]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id LONG, source STRING, text STRING, block INT").drop("block"), spark.createDataFrame(targets, "source STRING, target_share DOUBLE, max_repeats INT")


def test_mix(tables):
    docs, targets = tables
    rows, report = M.mix(docs, targets, shards=4)
    got = rows.collect()
    assert len({(r["doc_id"], r["copy_no"]) for r in got}) == len(got)
    said = {r["source"]: r for r in report.collect()}
    by = {s: [r for r in got if r["source"] == s] for s in ("big", "small")}
    total = sum(r["source_tokens"] for r in said.values())
    assert abs(sum(r["n_tokens"] for r in by["big"]) - 0.5 * total) <= 12
    assert len([r for r in by["small"] if r["n_tokens"]]) == 15 and max(r["copy_no"] for r in by["small"]) == 2
    assert {s for s, r in said.items() if not r["reachable"]} == {"small", "gone"}
    assert not {r["doc_id"] for r in got} & {2000, 2001}
    assert all(said[s]["planned_tokens"] - 9 <= sum(r["n_tokens"] for r in by[s]) <= said[s]["planned_tokens"] for s in by)
    assert rows.rdd.glom().map(lambda p: len({r["shard"] for r in p})).collect() == [1] * 4


def test_part_of_a_block(spark):
    """One block of a source is taken in part, and of that one inner block: the share is missed by less than a document."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    targets = spark.createDataFrame([("a", 0.4321, 5)], "source STRING, target_share DOUBLE, max_repeats INT")
    rows, report = M.mix(docs, targets)
    said, got = report.first(), rows.agg(F.sum("n_tokens"), F.count_distinct("doc_id"), F.count("*")).first()
    assert 0 <= said["planned_tokens"] - got[0] < 3 and got[1] == got[2] and said["reachable"]


def test_many_repeats_make_fewer_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_PLACES", 100)
    targets = spark.createDataFrame([("a", 1.0, 9)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert M.block_count(targets) == 10
    with pytest.raises(ValueError):
        M.block_count(spark.createDataFrame([("a", 1.0, 100)], targets.schema))


def test_found_and_edges(tables):
    docs, targets = tables
    assert {r["source"] for r in M.unreachable(docs, targets).collect()} == {"small", "gone"}
    assert {r["source"] for r in M.unreachable(docs.where(F.lit(False)), targets).collect()} == set()
    with pytest.raises(ValueError):
        M.unreachable(docs, targets.union(targets)).collect()
