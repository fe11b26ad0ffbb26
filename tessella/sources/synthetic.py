"""Synthetic element streams (idx, value), from spark.range alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.index import unravel, wrapping_add, wrapping_multiply
from tessella.plans.spec import ArraySpec, dtype


def _range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "idx")


def zeros(spark: SparkSession, n: int) -> DataFrame:
    return _range(spark, n).withColumn("value", F.lit(0).cast("bigint"))


def constant(spark: SparkSession, n: int, value: int) -> DataFrame:
    return _range(spark, n).withColumn("value", F.lit(value).cast("bigint"))


def ramp(spark: SparkSession, n: int, mask: int = 0xFFFF) -> DataFrame:
    """The index itself, masked."""
    return _range(spark, n).withColumn("value", F.col("idx").bitwiseAND(F.lit(mask).cast("bigint")))


def xor(spark: SparkSession, spec: ArraySpec, n: int) -> DataFrame:
    """Exclusive or of an element's coordinates, as wide as the element type."""
    out = F.lit(0).cast("bigint")
    for c in unravel("idx", [d.size for d in spec.dims], bounded=bool(spec.dims[0].size)):
        out = out.bitwiseXOR(c)
    bits = min(62, 8 * dtype(spec.dtype).nbytes)
    return _range(spark, n).withColumn("value", out.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))


# Fixed values of the generator splitmix64, and the seed of the test pattern.
_SEED = 0xDEADBEEFCAFEBABE
_STEP = 0x9E3779B97F4A7C15
_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SHIFTS = (30, 27, 31)


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")


def splitmix64(frame: DataFrame, place: Column, seed: int = _SEED) -> DataFrame:
    """The frame with ``z``: the value of splitmix64 at a place of its sequence, as 64 bits in a bigint.

    A projection for every step, as each uses the one before several times.
    """
    out = frame.withColumn("z", place + 1)
    out = out.withColumn("z", wrapping_multiply(F.col("z"), _STEP))
    out = out.withColumn("z", wrapping_add(F.col("z"), _signed(seed)))
    for shift, factor in zip(_SHIFTS, _FACTORS):
        out = out.withColumn("z", F.col("z").bitwiseXOR(F.shiftrightunsigned("z", shift)))
        out = out.withColumn("z", wrapping_multiply(F.col("z"), factor))
    return out.withColumn("z", F.col("z").bitwiseXOR(F.shiftrightunsigned("z", _SHIFTS[-1])))


def noise(spark: SparkSession, n: int, bits: int = 12, period: int | None = None, seed: int = _SEED) -> DataFrame:
    """The leading elements of the random pattern: the low bits of splitmix64, which begins anew every ``period`` elements."""
    place = F.col("idx") if period is None else F.col("idx") % period
    mixed = splitmix64(_range(spark, n), place, seed)
    return mixed.select("idx", F.col("z").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("value"))
