"""Joins, windows and sets as the engine's users need them, in forms that hold at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quality import first_of  # noqa: F401


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tie: str) -> DataFrame:
    """left and, from the last row of right at or before its time with the same keys, the given columns (JN-05).

    Both sides go through one window by key, so nothing is paired; of rows of right at one time the larger tie counts. A null time
    or key finds nothing.
    """
    own = [c for c in left.columns if c not in (*keys, time)]
    kinds = {f.name: f.dataType for f in right.schema.fields}
    packed = F.struct(*(F.col(c) for c in columns))
    a = left.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kinds[tie]).alias("__tie"), F.struct(*own).alias("__own"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("__p"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left.select(F.struct(*own).alias("o")).schema["o"].dataType).alias("__own"), packed.alias("__p"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", F.asc_nulls_first("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__p", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    known = F.col("__t").isNotNull()
    return out.select(*keys, F.col("__t").alias(time), "__own.*", *(F.when(known, F.col("__p")[c]).alias(c) for c in columns))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """points and the ranges [low, high) that hold their value (JN-06): an equi-join on buckets of width, then the exact test.

    width should be about the usual range; a range spans as many buckets as it is wide, so no pair is missed.
    """
    a = points.where(F.col(value).isNotNull()).withColumn("__b", F.floor(F.col(value) / width).cast("bigint"))
    good = ranges.where(F.col(low) < F.col(high))
    b = good.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor((F.col(high) - 1e-9) / width).cast("bigint"))))
    return a.join(b, "__b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__b")


def skewed_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """large joined to small on keys of which one may hold most rows of large: its rows are spread over salts tasks."""
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")).join(many, [*keys, "__salt"], how).drop("__salt")
