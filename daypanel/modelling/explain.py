"""What a fitted model reacts to: permutation importance and partial dependence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.modelling.search import PREDICTION
from daypanel.operators.order import column_statistics, hashed_rank
from daypanel.schema import DATE, ENTITY
from daypanel.session import durable


def permutation_importance(
    df: DataFrame, model: Transformer, features: Sequence[str], keys: Sequence[str] = (ENTITY, DATE), seed: int = 42
) -> DataFrame:
    """Mean squared change of the model's output when one feature is shuffled over the rows.

    A row gets the value of the row a fixed distance further in a hashed order, so it is a permutation, repeatable, and an equi-join on
    the rank. The distance is the same for all features, so one join brings the partner's whole row; it is unfolded to one row a feature
    after the join and reduced before the next shuffle. What is shuffled grows with the features, not with their square.
    """
    names = list(features)
    ranked = hashed_rank(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]), keys, seed)
    ranked = durable(ranked.select("rank0", "n_rows", *names), "ranked")
    further = F.lit(1) + F.pmod(F.xxhash64(F.lit(seed)), F.greatest(F.col("n_rows") - 1, F.lit(1)))
    if (weights := _line(model)) is not None and set(weights) <= set(names):
        partner = ranked.select(
            F.pmod(F.col("rank0") - further, F.col("n_rows")).alias("rank0"), *[F.col(c).alias(f"_p_{c}") for c in names]
        )
        # The output of a line changes by the coefficient times the change of the input, whatever the others are.
        moved = [F.avg(F.pow(F.lit(weights.get(c, 0.0)) * (F.col(c) - F.col(f"_p_{c}")), F.lit(2.0))).alias(c) for c in names]
        means = ranked.select("rank0", *names).join(partner, "rank0").agg(F.count(F.lit(1)).alias("_rows"), *moved).where("_rows > 0")
        return means.unpivot([], names, "feature", "importance")
    base = model.transform(ranked).select(
        *names, F.col(PREDICTION).alias("base"), F.pmod(F.col("rank0") + further, F.col("n_rows")).alias("rank0")
    )
    partners = ranked.select("rank0", *[F.col(c).alias(f"_p_{c}") for c in names])
    swaps = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_p_{c}").alias("shuffled")) for c in names])
    swapped = base.join(partners, "rank0").select(*names, "base", F.inline(swaps))
    swapped = swapped.select("feature", "base", *[F.when(F.col("feature") == c, F.col("shuffled")).otherwise(F.col(c)).alias(c) for c in names])
    delta = F.col("base") - F.col(PREDICTION)
    return model.transform(swapped).groupBy("feature").agg(F.avg(delta * delta).alias("importance"))


def _lowest(names: Sequence[str], most: int):
    """The lowest distinct values of each column that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0)] * len(names)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                held[i] = np.unique(np.concatenate([held[i], column.drop_null().to_numpy(zero_copy_only=False)]))[:most]
        for name, values in zip(names, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values)], ["feature", "value"])

    return run


def _line(model: Transformer) -> dict[str, float] | None:
    """The coefficient of each input, for a linear model of assembled columns; None for any other."""
    stages = model.stages if isinstance(model, PipelineModel) else []
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], LinearRegressionModel):
        return None
    if stages[0].getOutputCol() != stages[1].getFeaturesCol() or len(stages[0].getInputCols()) != len(stages[1].coefficients):
        return None
    weights: dict[str, float] = {}
    for c, w in zip(stages[0].getInputCols(), stages[1].coefficients.toArray().tolist(), strict=True):
        weights[c] = weights.get(c, 0.0) + w
    return weights


def feature_grids(
    df: DataFrame, features: Sequence[str], points: int = 100, low: float = 0.05, high: float = 0.95
) -> dict[str, list[float]]:
    """Values at which each feature is examined: all of them if few, else even steps between two quantiles.

    The quantiles use the plotting positions ``0.4 + 0.2 p`` (fixed values), and the result holds at
    most ``points`` numbers per feature.
    """
    names = list(features)

    def position(p: float, step: int):
        def at(n):
            place = n * F.lit(p) + F.lit(0.4 + 0.2 * p)
            k = F.floor(F.least(F.greatest(place, F.lit(1.0)), F.greatest(n - 1, F.lit(1)).cast("double"))).cast("bigint")
            return F.least(k - 1 + step, n - 1)

        return at

    picks = {f"{side}{step}": position(p, step) for side, p in (("low", low), ("high", high)) for step in (0, 1)}
    ends = {r["feature"]: r for r in column_statistics(df, names, picks, "feature").collect()}
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    known = cells.mapInArrow(_lowest(names, points), "feature string, value double")
    kept = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    fewest = known.distinct().withColumn("_at", kept).where(F.col("_at") <= points)  # one more than makes a feature one of few values
    few = {r["feature"]: r["values"] for r in fewest.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()}

    def edge(c: str, side: str, p: float) -> float:
        n = ends[c]["n"]
        place = n * p + 0.4 + 0.2 * p
        k = int(min(max(place, 1), max(n - 1, 1)))
        share = min(max(place - k, 0.0), 1.0)
        return (1 - share) * ends[c][f"{side}0"] + share * ends[c][f"{side}1"]

    grids = {}
    for c in names:
        if c in few and len(few[c]) < points:
            grids[c] = list(few[c])
        elif c in ends:
            a, b = edge(c, "low", low), edge(c, "high", high)
            grids[c] = [a + (b - a) * i / (points - 1) for i in range(points)]
    return grids


def partial_dependence(
    df: DataFrame, model: Transformer, features: Sequence[str], inputs: Sequence[str], points: int = 100
) -> DataFrame:
    """Mean prediction when one feature is set to each value of its grid for all rows.

    Each row is repeated per grid value by a generator and reduced again on the map side, so the
    shuffle carries one partial mean per (feature, value) and task.
    """
    df = durable(df.select(*dict.fromkeys([*inputs, *features])), "inputs")  # read several times
    grids = feature_grids(df, features, points)
    if (weights := _line(model)) is not None and set(grids) <= set(inputs):
        # The mean output of a line moves by the coefficient times the distance of the value from the column's mean.
        base = model.transform(df).agg(F.avg(PREDICTION).alias("_base"), *[F.avg(F.col(c).cast("double")).alias(c) for c in grids]).head()
        rows = [] if any(x is not None and math.isnan(x) for x in base) else [
            (c, float(v), base["_base"] + weights.get(c, 0.0) * (v - base[c])) for c, values in grids.items() for v in dict.fromkeys(values)
        ]
        if rows or not grids:
            return df.sparkSession.createDataFrame(rows, "feature string, value double, mean_prediction double")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("at")) for c, values in grids.items() for v in values]
    )
    repeated = df.select(*inputs, F.explode(cells).alias("_cell")).select(
        F.col("_cell.feature").alias("feature"),
        F.col("_cell.at").alias("at"),
        *[F.when(F.col("_cell.feature") == c, F.col("_cell.at")).otherwise(F.col(c)).alias(c) for c in inputs],
    )
    predicted = model.transform(repeated)
    return predicted.groupBy("feature", F.col("at").alias("value")).agg(F.avg(PREDICTION).alias("mean_prediction"))
