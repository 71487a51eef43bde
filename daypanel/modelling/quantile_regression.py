"""Linear quantile regression by repeated weighted least squares."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.modelling.search import PREDICTION
from daypanel.operators.fitted import fit_standard, scale_columns
from daypanel.schema import TARGET
from daypanel.session import durable


def pinball(residual: Column, q: float) -> Column:
    """The loss whose minimum is the conditional quantile."""
    return F.greatest(F.lit(q) * residual, F.lit(q - 1.0) * residual)


@dataclass(frozen=True)
class LinearQuantile:
    """``intercept + sum(coefficient * feature)``."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def transform(self, df: DataFrame, name: str = PREDICTION) -> DataFrame:
        value = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients, strict=True):
            value = value + F.lit(w) * F.col(c)
        return df.withColumn(name, value)


def _round(weights: np.ndarray, probs: Sequence[float], floor: float, first: bool):
    """One pass for all quantiles: the weighted normal equations and the loss of the present coefficients, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = weights.shape[1]
        sums, losses, rows = np.zeros((len(probs), size, size + 1)), np.zeros(len(probs)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]], 1)
            x, y = table[:, :-1], table[:, -1]
            rows += len(y)
            for k, q in enumerate(probs):
                residual = y - x @ weights[k]
                losses[k] += np.maximum(q * residual, (q - 1) * residual).sum()
                weight = np.ones(len(y)) if first else np.where(residual >= 0, q, 1 - q) / np.maximum(abs(residual), floor)
                sums[k] += x.T @ (table * weight[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows], pa.int64()), pa.array([losses.tolist()], pa.list_(pa.float64())), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))],
            ["rows", "losses", "sums"],
        )

    return run


def fit_quantiles(
    df: DataFrame,
    features: Sequence[str],
    probs: Mapping[str, float],
    target: str = TARGET,
    max_rounds: int = 60,
    tolerance: float = 1e-3,
) -> dict[str, LinearQuantile]:
    """Refit with weights ``|q - [residual < 0]| / |residual|`` until the pinball loss of every quantile settles.

    All quantiles share the passes. A pass reads the written rows and sends one matrix a task and quantile to the driver, whatever the
    number of rows; a round that is repeated after a lost executor gives the same sums.
    """
    names, asked = list(features), list(probs.values())
    rows = df.select(*names, F.col(target).cast("double").alias(target)).dropna()
    spread = fit_standard(rows, names).collect()
    deviation = rows.agg(F.stddev_pop(target)).head()[0] or 1.0
    scaled = scale_columns(rows, spread).select(*[F.col(c).cast("double") for c in names], target)
    scaled = durable(scaled, "scaled")
    size = len(names) + 1
    weights = np.zeros((len(asked), size))
    best, best_loss, last = weights.copy(), np.full(len(asked), np.inf), None
    for number in range(max_rounds + 1):
        parts = scaled.mapInArrow(
            _round(weights, asked, 1e-3 * deviation, number == 0), "rows long, losses array<double>, sums array<double>"
        ).collect()  # one row a task
        parts = sorted(parts, key=lambda r: (r["rows"], r["losses"]))
        n = sum(r["rows"] for r in parts)
        if not n:
            break
        loss = sum(np.array(r["losses"]) for r in parts) / n
        better = (loss < best_loss) & (number > 0)
        best[better], best_loss[better] = weights[better], loss[better]
        if last is not None and (abs(last - loss) <= tolerance * np.maximum(abs(last), 1e-12)).all():
            break
        last = loss if number else None
        sums = sum(np.array(r["sums"]) for r in parts).reshape(len(asked), size, size + 1)
        ridge = 1e-9 * np.eye(size)
        weights = np.stack([np.linalg.lstsq(s[:, :size] + ridge * np.trace(s[:, :size]), s[:, size], rcond=None)[0] for s in sums])
    centres = {r["column"]: (r["center"] or 0.0, r["scale"] or 1.0) for r in spread}
    models = {}
    for k, name in enumerate(probs):
        slopes = [best[k, i + 1] / centres[c][1] for i, c in enumerate(names)]
        intercept = best[k, 0] - sum(s * centres[c][0] for s, c in zip(slopes, names, strict=True))
        models[name] = LinearQuantile(tuple(names), tuple(map(float, slopes)), float(intercept))
    return models


def fit_quantile(
    df: DataFrame, features: Sequence[str], q: float, target: str = TARGET, max_rounds: int = 60, tolerance: float = 1e-3
) -> LinearQuantile:
    return fit_quantiles(df, features, {"q": q}, target, max_rounds, tolerance)["q"]


def predict_quantiles(df: DataFrame, models: Mapping[str, LinearQuantile]) -> DataFrame:
    """One column per fitted quantile."""
    out = df
    for name, model in models.items():
        out = model.transform(out, name)
    return out
