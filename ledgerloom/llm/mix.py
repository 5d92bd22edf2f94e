"""Problem 7: sources mixed to target weights.

Documents fall into blocks by a hash of their key, so a source is a bounded list of block sizes however large it is. The quotas of
blocks are exact; a multivariate-hypergeometric splitting tree divides them among the output shards, each shard takes disjoint runs
of the permuted block list of each source, and rows are shuffled inside their shard only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tokenize import DEFAULT_TOKENIZER, token_counts
from ledgerloom.session import cut

BLOCKS = 256
#: The assignment that is sent to every task has at most so many rows: more repeats make fewer, larger blocks.
MOST_PLACES = 1_000_000
#: A shard of the mix holds about so many tokens.
SHARD_TOKENS = 50_000_000


@dataclass
class Source:
    name: str
    share: float
    repeats: int
    blocks: np.ndarray  # tokens of each block, 0 where a block is empty
    need: Decimal
    passes: int = 0  # whole passes over the source
    whole: np.ndarray | None = None  # blocks of the last, partial pass that are taken whole
    part: int = -1  # the block of that pass that is taken in part
    part_tokens: int = 0

    @property
    def tokens(self) -> int:
        return int(self.blocks.sum())


def block_of(key: str, blocks: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(blocks)).cast("int")


def sized(docs: DataFrame, targets: DataFrame, key: str, source: str, text: str, tokenizer: str, blocks: int, seed: int) -> DataFrame:
    """(key, source, block, n_tokens) of the documents of listed sources; documents of other sources are left out before encoding."""
    listed = targets.select(F.col("source").alias(source)).where(F.col(source).isNotNull()).distinct()
    kept = docs.select(key, source, text).join(listed, source, "left_semi")
    return token_counts(kept, [key, source], text, tokenizer).withColumn("block", block_of(key, blocks, seed))


def plan(rows: DataFrame, targets: DataFrame, source: str = "source", blocks: int = BLOCKS, total: int | None = None, seed: int = 7) -> list[Source]:
    """What each source contributes. The driver holds one number for each source and block, however many documents there are.

    total is the size of the mix in tokens, all tokens of the listed sources if not given. A target of null or negative share, or of
    null repeats, counts as 0; a source listed twice raises.
    """
    sums = rows.groupBy(source, "block").agg(F.sum("n_tokens").alias("n")).collect()
    by: dict[str, np.ndarray] = {}
    for s, b, n in sums:
        by.setdefault(s, np.zeros(blocks, np.int64))[b] = n
    wanted = [(r["source"], max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 0, 0)) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").orderBy("source").collect()]
    if len({w[0] for w in wanted}) < len(wanted):
        raise ValueError("a source is listed twice")
    size = Decimal(sum(int(by[s].sum()) for s, _, _ in wanted if s in by) if total is None else total)
    out = []
    for k, (name, share, repeats) in enumerate(wanted):
        s = Source(name, share, repeats, by.get(name, np.zeros(blocks, np.int64)), Decimal(str(share)) * size)
        if s.tokens:
            left = min(math.ceil(s.need), s.repeats * s.tokens)
            s.passes, left = divmod(left, s.tokens)
            order = np.random.default_rng([seed, k]).permutation(np.flatnonzero(s.blocks))
            reach = np.cumsum(s.blocks[order])
            n = int(np.searchsorted(reach, left, "right"))
            s.whole = order[:n]
            s.part_tokens = left - int(reach[n - 1] if n else 0)
            s.part = int(order[n]) if n < len(order) and s.part_tokens else -1
        out.append(s)
    return out


def assigned(sources: list[Source], places: list[tuple[str, int, int, int]]) -> dict[str, int]:
    """The tokens of each source that the shards were given."""
    by, out = {s.name: s for s in sources}, {s.name: 0 for s in sources}
    for name, block, copy, _ in places:
        s = by[name]
        out[name] += s.part_tokens if block == s.part and copy == s.passes else int(s.blocks[block])
    return out


REPORT = "source STRING, target_share DOUBLE, max_repeats INT, source_tokens BIGINT, target_tokens DOUBLE, planned_tokens BIGINT, planned_share DOUBLE, reachable BOOLEAN"


def report(spark: SparkSession, sources: list[Source], places: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row for each listed source: what it should and will contribute, and whether that is enough.

    A source is reachable if the blocks that the shards were given have the tokens it needs.
    """
    given = assigned(sources, places)
    total = sum(given.values())
    rows = [(s.name, s.share, s.repeats, s.tokens, float(s.need), given[s.name], given[s.name] / total if total else 0.0, given[s.name] >= s.need) for s in sources]
    return spark.createDataFrame(rows, REPORT)


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts (blocks still to place of each source) over shards, by halving: each left side is a multivariate-hypergeometric draw."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    draw = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals")
    return np.vstack([split(draw, left, rng), split(counts - draw, shards - left, rng)])


def assign(sources: list[Source], shards: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(source, block, copy, shard): every block of every pass in exactly one shard; the block taken in part comes last, as copy passes."""
    rng = np.random.default_rng([seed, 1])
    lists = []
    for s in sources:
        filled = np.flatnonzero(s.blocks)
        own = [(b, c) for c in range(s.passes) for b in filled] + [(b, s.passes) for b in (s.whole if s.whole is not None else [])]
        own += [(s.part, s.passes)] * (s.part >= 0)
        lists.append([own[i] for i in rng.permutation(len(own))])
    per_shard = split(np.array([len(x) for x in lists], np.int64), shards, rng)
    out, at = [], [0] * len(lists)
    for shard, counts in enumerate(per_shard):
        for k, n in enumerate(counts):
            out += [(sources[k].name, int(b), int(c), shard) for b, c in lists[k][at[k] : at[k] + n]]
            at[k] += int(n)
    return out


def block_count(targets: DataFrame, most: int = BLOCKS) -> int:
    """How many blocks a source has: fewer where many repeats would make the assignment too long."""
    copies = targets.agg(F.coalesce(F.sum(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)) + 1), F.lit(1))).first()[0]
    if copies > MOST_PLACES:
        raise ValueError("the repeats are too many for an assignment of blocks")
    return max(1, min(most, MOST_PLACES // copies))


def laid_out(rows: DataFrame, targets: DataFrame, source: str, blocks: int, total: int | None, seed: int, shards: int | None) -> tuple[list[Source], list[tuple[str, int, int, int]], int]:
    """(sources, places, shards): the quotas of blocks and the shards that the splitting tree gives them to."""
    sources = plan(rows, targets, source, blocks, total, seed)
    if shards is None:
        shards = max(16, math.ceil(sum(min(float(s.need), s.repeats * s.tokens) for s in sources) / SHARD_TOKENS))
    return sources, assign(sources, shards, seed), shards


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, shards: int | None = None, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: source, key, n_tokens, copy_no from 0, shard, place (a pseudo-random number that orders its shard).

    No document appears more than max_repeats times; a source that cannot reach its share gives all it may, and the report says so.
    Documents of zero tokens (null and empty texts) carry no weight and ride along with their block. The one block of a source that
    is taken in part is cut into blocks once more; of the one of these that is taken in part, documents are taken in hashed order
    while they fit, so a share is missed by less than one document and no task holds more than a 65,536th of a source. Documents of
    null or unlisted source, and rows of null key, are left out. shards: one for each SHARD_TOKENS if not given. The joined assignment
    has at most MOST_PLACES rows; documents are shuffled once, to their shard.
    """
    spark = docs.sparkSession
    blocks = block_count(targets)
    rows = cut(sized(docs.where(F.col(key).isNotNull()), targets, key, source, text, tokenizer, blocks, seed))
    sources, places, shards = laid_out(rows, targets, source, blocks, total, seed, shards)
    fields = [T.StructField(source, T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("copy_no", T.IntegerType())]
    where = spark.createDataFrame(places, T.StructType([*fields, T.StructField("shard", T.IntegerType())]))
    in_part = {s.name: s for s in sources if s.part >= 0}
    part = spark.createDataFrame([(s.name, s.part, s.passes) for s in in_part.values()], T.StructType(fields))
    # the blocks taken in part, cut once more by another hash
    again = rows.join(F.broadcast(part), [source, "block"]).withColumn("inner", block_of(key, BLOCKS, seed + 1))
    sums: dict[str, dict[int, int]] = {}
    for name, inner, n in again.groupBy(source, "inner").agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(name, {})[inner] = n
    chosen = []
    for k, (name, s) in enumerate(in_part.items()):
        left = s.part_tokens
        order = np.random.default_rng([seed, 2, k]).permutation(sorted(sums.get(name, {})))
        for inner in order.tolist():
            n = sums[name][inner]
            chosen.append((name, inner, min(n, left), n <= left))
            left -= min(n, left)
            if not left:
                break
    inner = spark.createDataFrame(chosen, T.StructType([fields[0], T.StructField("inner", T.IntegerType()), T.StructField("quota", T.LongType()), T.StructField("all", T.BooleanType())]))
    picked = again.join(F.broadcast(inner), [source, "inner"])
    running = f"sum(n_tokens) OVER (PARTITION BY `{source}`, inner ORDER BY xxhash64({seed}, `{key}`, 'part'), `{key}` ROWS UNBOUNDED PRECEDING)"
    some = picked.where("NOT all").withColumn("__run", F.expr(running)).where("__run <= quota")
    whole = rows.join(F.broadcast(where.join(part, [source, "block", "copy_no"], "left_anti")), [source, "block"])
    columns = [source, key, "n_tokens", "copy_no", "shard"]
    out = whole.select(columns)
    for taken in (picked.where("all"), some):
        out = out.unionByName(taken.join(F.broadcast(where), [source, "block", "copy_no"]).select(columns))
    out = out.withColumn("place", F.xxhash64(F.lit(seed), F.col("shard"), F.col("copy_no"), F.col(key)))
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", key), report(spark, sources, places)


def unreachable(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(source) of the listed sources that the mix gives less than their share, though each document is repeated as often as it may be."""
    blocks = block_count(targets)
    rows = sized(docs.where(F.col(key).isNotNull()), targets, key, source, text, tokenizer, blocks, 7)
    sources, places, _ = laid_out(rows, targets, source, blocks, None, 7, None)
    return report(docs.sparkSession, sources, places).where("NOT reachable").select("source")
