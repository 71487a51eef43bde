"""Prediction intervals: conditional quantiles, conformal widening and their quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.scalar import clamp_nonnegative, season_name
from daypanel.operators.order import attach, global_rank, order_statistics, quantiles
from daypanel.schema import DATE, ENTITY, OBS

LOWER, UPPER = 0.05, 0.95


def calibration_split(df: DataFrame, share: float = 0.2, at_least: int = 20, needs_more_than: int = 50) -> DataFrame:
    """Mark the last rows by date as ``calibration``; with too few rows all of them are ``fit``."""
    ranked = global_rank(df)
    held = F.greatest(F.lit(at_least), F.floor(F.col("n_rows") * F.lit(share)))
    late = (F.col("n_rows") > needs_more_than) & (F.col("rank0") >= F.col("n_rows") - held)
    return ranked.withColumn("part", F.when(late, "calibration").otherwise("fit")).drop("rank0", "n_rows")


def condition_columns(df: DataFrame, lag: str, cuts: Sequence[float] | DataFrame) -> DataFrame:
    """The group a row is predicted from: its season and the bucket of a past value (-1 if unknown).

    The borders are numbers, or the one row of :func:`lag_cut_row`, which is attached as a scalar subquery.
    """
    if isinstance(cuts, DataFrame):
        names = cuts.columns
        return condition_columns(attach(df, cuts), lag, [F.col(c) for c in names]).drop(*names)
    bucket = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        bucket = F.when(F.col(lag) < (cut if isinstance(cut, Column) else float(cut)), F.lit(i)).otherwise(bucket)
    return df.withColumn("season", season_name(F.col(DATE))).withColumn(
        "lag_bucket", F.when(F.col(lag).isNull(), F.lit(-1)).otherwise(bucket)
    )


def fit_group_quantiles(
    df: DataFrame, by: Sequence[str], lower: float = LOWER, upper: float = UPPER, value: str = OBS
) -> DataFrame:
    """Exact lower, middle and upper quantile per group (groups of any size)."""
    return quantiles(df, value, {"lo": lower, "med": 0.5, "hi": upper}, by)


def quantile_predict(df: DataFrame, fitted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with its group's quantiles; a row of an unseen group has none."""
    return df.join(fitted, list(by), "left")


def coverage_rank(n: Column, lower: float = LOWER, upper: float = UPPER) -> Column:
    """Which smallest score widens the band to the nominal coverage (1-based)."""
    return F.least(F.greatest(F.ceil((n + 1) * F.lit(upper - lower)), F.lit(1)), n)


def conformal_calibrate(
    df: DataFrame, lower: float = LOWER, upper: float = UPPER, lo: str = "lo", hi: str = "hi", value: str = OBS
) -> DataFrame:
    """One row ``(n, k, q)``: the k-th smallest distance of the truth outside its band."""
    outside = F.greatest(F.col(lo) - F.col(value), F.col(value) - F.col(hi))
    scores = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & F.col(value).isNotNull()).select(
        outside.alias("score")
    )
    picked = order_statistics(scores, "score", {"q": lambda n: coverage_rank(n, lower, upper) - 1})
    return picked.select("n", coverage_rank(F.col("n"), lower, upper).alias("k"), "q")


def predict_interval(df: DataFrame, widening: DataFrame | None, non_negative: bool = True) -> DataFrame:
    """Bands widened by the calibrated distance, put in order and kept at or above zero."""
    wider = attach(df, widening.select(F.col("q").alias("_q"))) if widening is not None else df.withColumn("_q", F.lit(0.0))
    q = F.coalesce(F.col("_q"), F.lit(0.0))
    known = F.col("lo").isNotNull() & F.col("med").isNotNull() & F.col("hi").isNotNull()
    ordered = F.when(known, F.array_sort(F.array(F.col("lo") - q, F.col("med"), F.col("hi") + q)))
    edges = {"lo": F.col("_band")[0], "med": F.col("_band")[1], "hi": F.col("_band")[2]}
    final = {name: clamp_nonnegative(e) if non_negative else e for name, e in edges.items()}
    banded = wider.withColumn("_band", ordered)
    return banded.select(*[final[c].alias(c) if c in final else F.col(c) for c in df.columns])


def interval_quality(
    df: DataFrame, by: Sequence[str] = (), lower: float = LOWER, upper: float = UPPER, value: str = OBS
) -> DataFrame:
    """Share of truths inside the closed band, its mean width, and the distance from nominal coverage."""
    usable = df.where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col(value).isNotNull())
    inside = F.avg(F.when((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")), 1.0).otherwise(0.0))
    nominal = F.lit(upper - lower)
    return usable.groupBy(*by).agg(
        F.round(nominal, 3).alias("nominal_coverage"),
        F.round(inside, 4).alias("picp_observed_coverage"),
        F.round(F.avg(F.col("hi") - F.col("lo")), 4).alias("mpiw_mean_interval_width"),
        F.round(inside - nominal, 4).alias("coverage_error"),
    )


def interval_series(df: DataFrame, limit: int = 400) -> DataFrame:
    """The first rows of the bands in date order, for a chart."""
    return df.select(DATE, ENTITY, OBS, "lo", "med", "hi").orderBy(DATE, ENTITY).limit(limit)


def lag_cut_row(df: DataFrame, lag: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Bucket borders of a past value, learned from the fit rows, as one row."""
    return quantiles(df, lag, {f"_cut{i}": q for i, q in enumerate(probs)})


def lag_cuts(df: DataFrame, lag: str, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> list[float]:
    """The borders of :func:`lag_cut_row` as numbers."""
    row = lag_cut_row(df, lag, probs).head()
    return list(row) if row else []
