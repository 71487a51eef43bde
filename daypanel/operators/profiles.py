"""Describing a panel: missing values, distribution, climatology, correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.operators.order import attach, quantiles
from daypanel.schema import DATE, PRECIP, TARGET


def _unfold(df: DataFrame, structs: dict[str, Column]) -> DataFrame:
    """One aggregate over one scan, whose struct results become rows."""
    packed = df.agg(*[s.alias(f"x{i}") for i, s in enumerate(structs.values())])
    return packed.select(F.inline(F.array(*[f"x{i}" for i in range(len(structs))])))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of each column."""
    names = list(columns or df.columns)
    rows = F.count(F.lit(1))
    return _unfold(
        df,
        {
            c: F.struct(
                F.lit(c).alias("column"),
                (rows - F.count(c)).alias("missing"),
                (F.try_divide(rows - F.count(c), rows) * 100).alias("missing_pct"),
            )
            for c in names
        },
    )


def describe_panel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, with the date range of the panel."""
    names = list(columns)
    stats = _unfold(
        df,
        {
            c: F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.min(DATE).alias("first_day"),
                F.max(DATE).alias("last_day"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in names
        },
    )
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "column", "value")
    quartiles = quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column"])
    return stats.join(quartiles, "column", "left")


def monthly_climatology(df: DataFrame, columns: Sequence[str] = (TARGET, PRECIP)) -> DataFrame:
    return df.groupBy(F.month(DATE).alias("month")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


class CoMoments:
    """Rows, means and centred products of all pairs of columns, over the rows where both are known; two of them can be merged.

    ``mean[i, j]`` and ``square[i, j]`` belong to column i over the rows of the pair (i, j).
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, cross: np.ndarray, square: np.ndarray):
        self.n, self.mean, self.cross, self.square = n, mean, cross, square

    @classmethod
    def of(cls, values: np.ndarray, known: np.ndarray) -> CoMoments:
        """By matrix products; values are taken relative to the first known one of their column, so a flat column has no spread at all."""
        first = values[known.argmax(0), np.arange(values.shape[1])]
        first = np.where(known.any(0), first, 0.0)
        x, m = np.where(known, values - first, 0.0), known.astype(float)
        n = m.T @ m
        some = np.maximum(n, 1.0)
        total = x.T @ m
        cross, square = x.T @ x - total * total.T / some, (x * x).T @ m - total * total / some
        return cls(n, np.where(n > 0, first[:, None] + total / some, 0.0), cross, square)

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        gap, weight = other.mean - self.mean, self.n * other.n / some
        mean = np.where(self.n > 0, self.mean + gap * other.n / some, other.mean)
        return CoMoments(n, mean, self.cross + other.cross + gap * gap.T * weight, self.square + other.square + gap * gap * weight)


def _co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has seen, a row for each pair of columns."""
    seen: CoMoments | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = np.stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        values = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        own = CoMoments.of(values, known)
        seen = seen.merged(own) if seen else own
    if seen:
        i, j = np.triu_indices(len(seen.n))
        cells = [seen.n[i, j], seen.mean[i, j], seen.mean[j, i], seen.cross[i, j], seen.square[i, j], seen.square[j, i]]
        names = ["i", "j", "n", "mx", "my", "sxy", "sxx", "syy"]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, cells)], names)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, as long rows, over the rows where both are known.

    One scan: a task adds up matrix products of its Arrow batches and hands on one row a pair, so what is shuffled grows with the
    tasks and pairs, never with the rows. The parts of a pair are merged by their means, which loses no digits.
    """
    names = list(columns)
    wide = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    fields = ["n", "mx", "my", "sxy", "sxx", "syy"]
    parts = wide.mapInArrow(_co_moments, "i int, j int, " + ", ".join(f"{c} double" for c in fields))
    gathered = parts.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))  # a row a task

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        weight = F.when(n > 0, a["n"] * b["n"] / n).otherwise(0.0)
        share = F.when(n > 0, b["n"] / n).otherwise(0.0)
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        return F.struct(
            n.alias("n"),
            F.when(a["n"] > 0, a["mx"] + dx * share).otherwise(b["mx"]).alias("mx"),
            F.when(a["n"] > 0, a["my"] + dy * share).otherwise(b["my"]).alias("my"),
            (a["sxy"] + b["sxy"] + dx * dy * weight).alias("sxy"),
            (a["sxx"] + b["sxx"] + dx * dx * weight).alias("sxx"),
            (a["syy"] + b["syy"] + dy * dy * weight).alias("syy"),
        )

    nothing = F.struct(*[F.lit(0.0).alias(c) for c in fields])
    label = F.array(*[F.lit(c) for c in names])
    half = gathered.select(
        label[F.col("i")].alias("column_a"), label[F.col("j")].alias("column_b"), F.aggregate("parts", nothing, merged).alias("m")
    )
    varies = (F.col("m.sxx") > 0) & (F.col("m.syy") > 0)
    r = F.when(varies, F.try_divide(F.col("m.sxy"), F.sqrt("m.sxx") * F.sqrt("m.syy")))
    a, b = F.col("column_a"), F.col("column_b")
    cells = F.array(
        F.struct(a.alias("column_a"), b.alias("column_b"), r.alias("correlation")),
        F.when(a != b, F.struct(b.alias("column_a"), a.alias("column_b"), r.alias("correlation"))),
    )
    return half.select(F.inline(F.array_compact(cells)))


def histogram(df: DataFrame, column: str = TARGET, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal steps between the extremes; the last step includes its upper edge."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    edges = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
    counted = (
        attach(known, edges)
        .withColumn("bin", F.least(place, F.lit(bins - 1)))
        .groupBy("bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"), "n"
    )
