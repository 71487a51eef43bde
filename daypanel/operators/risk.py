"""Flood and drought risk of each entity from its predicted flow."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.scalar import clamp_nonnegative, ratio
from daypanel.operators.order import attach, series_quantiles
from daypanel.operators.panel import attach_risk_attrs
from daypanel.operators.series import longest_run_below
from daypanel.schema import BASIN, DATE, ENTITY, PRED, RISK_CUTS, RISK_LEVELS

SMALL_FLOW = 0.01


def risk_level(score: Column, cuts: Sequence[float] = RISK_CUTS, labels: Sequence[str] = RISK_LEVELS) -> Column:
    """The label of the first cut that the score is strictly below; the last label above all cuts."""
    label = F.lit(labels[len(cuts)])
    for cut, name in reversed(list(zip(cuts, labels, strict=False))):
        label = F.when(score < cut, F.lit(name)).otherwise(label)
    return label


def _flows(df: DataFrame, value: str) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    return rows.select(ENTITY, DATE, clamp_nonnegative(F.col(value).cast("double")).alias("flow"))


def _unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _mean_flow() -> Column:
    return F.avg("flow") + F.lit(SMALL_FLOW)


def _flood_of(share: Column, high: Column, spread: Column) -> Column:
    """From the share of high flows, and the 99 % quantile and the deviation over the mean."""
    often = F.least(share * 20, F.lit(1.0))
    large = F.least(high / 10, F.lit(1.0))
    varied = F.least(spread / 3, F.lit(1.0))
    return _unit(F.lit(0.4) * often + F.lit(0.4) * large + F.lit(0.2) * varied)


def _flood() -> Column:
    return _flood_of(_share(F.col("flow") > F.col("p95")), ratio(F.max("p99"), _mean_flow()), ratio(F.stddev_pop("flow"), _mean_flow()))


def _drought_parts_of(low: Column, share: Column) -> tuple[Column, Column]:
    """From the 5 % quantile over the mean and the share of low flows."""
    return F.lit(1.0) - F.least(low, F.lit(1.0)), F.least(share * 10, F.lit(1.0))


def _drought_parts() -> tuple[Column, Column]:
    return _drought_parts_of(ratio(F.max("p5"), _mean_flow()), _share(F.col("flow") < F.col("p10")))


def _drought(low: Column, often: Column, run: Column) -> Column:
    lasting = F.least(run / 90, F.lit(1.0))
    return _unit(F.lit(0.3) * low + F.lit(0.3) * often + F.lit(0.4) * lasting)


#: What the scores of an entity are made of.
STATISTICS = "n_rows bigint, p5 double, p99 double, _high double, _below double, mean_flow double, max_flow double, std_flow double, longest_run bigint"


def _above(a: np.ndarray, b: float) -> np.ndarray:
    """``a > b`` where NaN is larger than any number, as Spark orders it."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _quantile(ordered: np.ndarray, q: float) -> float:
    place = (len(ordered) - 1) * q
    low, high = math.floor(place), math.ceil(place)
    if ordered[low] == ordered[high] or low == high:
        return float(ordered[low])
    return float((high - place) * ordered[low] + (place - low) * ordered[high])


def series_statistics(entities: pa.Array, day: np.ndarray, flows: np.ndarray) -> pa.RecordBatch:
    """A row of :data:`STATISTICS` for each entity of a batch of whole entities, whose rows stand by entity and day."""
    flows = np.where(flows < 0, 0.0, flows)
    known = pc.dictionary_encode(entities, null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
    rows = []
    for own, at in zip(np.split(flows, starts[1:]), np.split(day, starts[1:]), strict=True):
        ordered = np.sort(own)
        p5, p10, p95, p99 = (_quantile(ordered, q) for q in (0.05, 0.10, 0.95, 0.99))
        below = ~_above(own, p10) & (own != p10) & ~np.isnan(own)
        if (at[1:] == at[:-1]).any():  # of the rows of a day, which have no order, the last one comes first
            order = np.lexsort((-np.arange(len(at)), at))
            at, below = at[order], below[order]
        # The runs are numbered by the day of the last row not below the limit, as longest_run_below does.
        since = np.maximum.accumulate(np.where(below, -1, at))
        run = int(np.unique(since[below], return_counts=True)[1].max()) if below.any() else 0
        rows.append((len(own), p5, p99, float(_above(own, p95).mean()), float(below.mean()), float(own.mean()), float(ordered[-1]), float(own.std()), run))
    names = [part.split()[0] for part in STATISTICS.split(", ")]
    kinds = [pa.int64() if part.endswith("bigint") else pa.float64() for part in STATISTICS.split(", ")]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([entities.take(pa.array(starts)), *columns], [ENTITY, *names])


def _scores_of(statistics: DataFrame, min_rows: int) -> DataFrame:
    """The columns of :func:`raw_scores` from :data:`STATISTICS`."""
    mean = F.col("mean_flow") + F.lit(SMALL_FLOW)
    flood = _flood_of(F.col("_high"), ratio(F.col("p99"), mean), ratio(F.col("std_flow"), mean))
    low, often = _drought_parts_of(ratio(F.col("p5"), mean), F.col("_below"))
    rows = statistics.where(F.col(ENTITY).isNotNull() & (F.col("n_rows") >= min_rows))
    shown = ["n_rows", flood.alias("flood_score"), "mean_flow", "max_flow", "std_flow", "longest_run"]
    return rows.select(ENTITY, *shown, _drought(low, often, F.col("longest_run")).alias("drought_score"))


def raw_scores(df: DataFrame, value: str = PRED, min_rows: int = 30) -> DataFrame:
    """Unrounded scores and flow statistics per entity with enough rows: one pass for thresholds, one for scores."""
    flows = _flows(df, value)
    limits = series_quantiles(flows, "flow", {"p5": 0.05, "p10": 0.10, "p95": 0.95, "p99": 0.99})
    marked = attach(flows, limits, [ENTITY])
    low, often = _drought_parts()
    stats = marked.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _flood().alias("flood_score"),
        low.alias("_low"),
        often.alias("_often"),
        F.avg("flow").alias("mean_flow"),
        F.max("flow").alias("max_flow"),
        F.stddev_pop("flow").alias("std_flow"),
    )
    runs = longest_run_below(marked, "flow", "p10")
    return (
        stats.where(F.col("n_rows") >= min_rows)
        .join(runs, ENTITY)
        .withColumn("drought_score", _drought(F.col("_low"), F.col("_often"), F.col("longest_run")))
        .drop("_low", "_often")
    )


def flood_score(df: DataFrame, value: str = PRED) -> DataFrame:
    flows = _flows(df, value)
    limits = series_quantiles(flows, "flow", {"p95": 0.95, "p99": 0.99})
    return attach(flows, limits, [ENTITY]).groupBy(ENTITY).agg(_flood().alias("flood_score"))


def drought_score(df: DataFrame, value: str = PRED) -> DataFrame:
    return raw_scores(df, value, min_rows=1).select(ENTITY, "drought_score", "longest_run")


def risk_scores(
    df: DataFrame | None,
    attributes: DataFrame | None = None,
    value: str = PRED,
    min_rows: int = 30,
    flood_cuts: Sequence[float] = RISK_CUTS,
    drought_cuts: Sequence[float] | None = None,
    labels: Sequence[str] = RISK_LEVELS,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Scores, levels (from the unrounded scores) and flow statistics per entity, with its attributes.

    ``statistics``, a row of :data:`STATISTICS` an entity, stands for the rows of ``df`` where they were reduced before.
    """
    raw = raw_scores(df, value, min_rows) if statistics is None else _scores_of(statistics, min_rows)
    raw = raw.withColumn(
        "combined_score", F.lit(0.5) * F.col("flood_score") + F.lit(0.5) * F.col("drought_score")
    )
    drought_cuts = flood_cuts if drought_cuts is None else drought_cuts
    cuts = {"flood": flood_cuts, "drought": drought_cuts, "combined": flood_cuts}
    rows = raw.select(
        ENTITY,
        *[F.round(f"{k}_score", 4).alias(f"{k}_risk_score") for k in cuts],
        *[risk_level(F.col(f"{k}_score"), c, labels).alias(f"{k}_risk_level") for k, c in cuts.items()],
        F.round("mean_flow", 3).alias("mean_predicted_flow"),
        F.round("max_flow", 3).alias("max_predicted_flow"),
        F.round(ratio(F.col("std_flow"), F.col("mean_flow") + F.lit(SMALL_FLOW)), 4).alias("cv_predicted_flow"),
    )
    return attach_risk_attrs(rows, attributes) if attributes is not None else rows


def risk_distribution(risk: DataFrame) -> DataFrame:
    """Entities per level, for flood and drought, with the total beside them."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("risk_type"), F.col(f"{k}_risk_level").alias("level")) for k in ("flood", "drought")]
    )
    counts = risk.select(F.explode(kinds).alias("x")).select("x.*").groupBy("risk_type", "level").agg(
        F.count(F.lit(1)).alias("n_catchments")
    )
    return counts.withColumn("total_catchments", risk.agg(F.count(F.lit(1)).alias("n")).scalar())


def risk_by_basin(risk: DataFrame, group: str = BASIN) -> DataFrame:
    return risk.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_catchments"),
        F.round(F.avg("flood_risk_score"), 4).alias("mean_flood_risk"),
        F.round(F.avg("drought_risk_score"), 4).alias("mean_drought_risk"),
    )


def rank_risk(risk: DataFrame, kind: str = "flood") -> DataFrame:
    """Entities from the highest to the lowest score."""
    return risk.select(ENTITY, f"{kind}_risk_score", f"{kind}_risk_level").orderBy(
        F.desc(f"{kind}_risk_score"), ENTITY
    )
