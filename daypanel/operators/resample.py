"""Repeatable resampling of extreme rows. All draws come from hashes, so they do not depend on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.operators.order import attach, hashed_rank, quantiles
from daypanel.schema import DATE, ENTITY, TARGET


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) drawn from the hash of its arguments."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def gaussian(*parts: Column | str) -> Column:
    """A standard normal draw from two hashed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(F.lit("r"), *parts)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(F.lit("a"), *parts))


def extreme_rows(df: DataFrame, target: str = TARGET, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Rows at or beyond the high or low quantile of the target over all rows."""
    limits = quantiles(df, target, {"_high": high, "_low": low})
    marked = attach(df, limits)
    return marked.where((F.col(target) >= F.col("_high")) | (F.col(target) <= F.col("_low"))).drop("_high", "_low")


def oversample_extremes(
    df: DataFrame,
    features: Sequence[str],
    share: float = 0.5,
    target: str = TARGET,
    seed: int = 42,
    feature_noise: float = 0.05,
    target_noise: float = 0.02,
) -> DataFrame:
    """Append noisy copies of randomly drawn extreme rows.

    ``int(share * extremes)`` draws with replacement. A copy keeps the entity and the date of its
    seed row and carries ``is_synthetic``, so that splits by time and validation can tell it apart.
    """
    original = df.withColumn("is_synthetic", F.lit(False))
    seeds = hashed_rank(extreme_rows(df, target), [ENTITY, DATE], seed)
    n = seeds.count()
    draws = int(n * share)
    if draws == 0:
        return original
    picked = df.sparkSession.range(draws).select(
        F.col("id").alias("_draw"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("rank0")
    )
    spreads = df.agg(
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in [*features, target]]
    )
    copies = attach(picked.join(seeds, "rank0"), spreads)

    def noisy(c: str) -> Column:
        level = target_noise if c == target else feature_noise
        return (F.col(c) + F.lit(level) * F.col(f"_s_{c}") * gaussian(F.lit(seed), F.lit(c), F.col("_draw"))).alias(c)

    jittered = {*features, target}
    synthetic = copies.select(
        *[noisy(c) if c in jittered else F.col(c) for c in df.columns], F.lit(True).alias("is_synthetic")
    )
    return append_synthetic(original, synthetic)


def append_synthetic(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    return original.unionByName(synthetic)
