"""Scoring all entities at once with a fitted model and its parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from daypanel.modelling.explain import _line
from daypanel.modelling.search import PREDICTION
from daypanel.operators.features import FeatureConfig, calendar_days, engineer_features, made_columns, reduced_features
from daypanel.operators.fitted import apply_params, carried_features
from daypanel.operators.panel import HeldPanel, date_floor_filter
from daypanel.operators.risk import STATISTICS, risk_scores, series_statistics
from daypanel.schema import BASIN, DATE, ENTITY
from daypanel.session import durable
from daypanel.sources.writers import prediction_rows


def _prepared(panel: DataFrame | HeldPanel, params: DataFrame, cfg: FeatureConfig, start: str | None) -> DataFrame:
    fitted = params.collect()
    if isinstance(panel, HeldPanel):
        names = [p["column"] for p in fitted if not p["dropped"]]
        keep = [ENTITY, DATE, *([BASIN] if BASIN in panel.fields("_copies") else [])]
        return apply_params(carried_features(panel, cfg, names, keep, since=start), fitted, keep, carried=True)
    features = engineer_features(panel, cfg)
    rows = date_floor_filter(features, start) if start else features
    return apply_params(rows, fitted, [c for c in (ENTITY, DATE, BASIN) if c in rows.columns])


def _line_terms(panel: HeldPanel, fitted: Sequence[Row], model: Transformer, cfg: FeatureConfig) -> list[tuple[str, tuple | np.ndarray]] | None:
    """What each input adds to the output of a linear model, in the order of the inputs; None for another model or other inputs.

    An attribute of the entity or a feature of earlier rows has its fitted median, center, scale and coefficient, a feature of the day
    alone what it adds on each day of the calendar, which is no longer than that.
    """
    weights, used = _line(model), {p["column"]: p for p in fitted if not p["dropped"]}
    if weights is None or not set(weights) <= set(used) or any(used[c][k] is None for c in weights for k in ("median", "center", "scale")):
        return None
    own = {**panel.fields("_copies"), **made_columns(panel, cfg)}
    dated = calendar_days(panel, cfg)
    listed = [c for c in weights if c not in own and c in dated.columns]
    if not set(weights) <= {*own, *listed}:  # features of values of the row itself
        return None
    scaled = apply_params(dated, [used[c] for c in listed], ["pos"], carried=True).orderBy("pos").collect()
    by_day = {c: np.array([r[c] for r in scaled], float) * weights[c] for c in listed}
    return [(c, by_day[c] if c in by_day else (*(used[c][k] for k in ("median", "center", "scale")), weights[c])) for c in weights]


def _summed(terms: Sequence[tuple[str, tuple | np.ndarray]], intercept: float, batch: pa.RecordBatch) -> np.ndarray:
    """The output of the linear model for the rows of a batch."""
    total, day = np.zeros(batch.num_rows), batch.column("pos").to_numpy() - 1
    for c, term in terms:
        if isinstance(term, np.ndarray):
            total += term[day]
        else:
            median, center, scale, weight = term
            cells = pc.fill_null(pc.cast(batch.column(c), pa.float64()), float(median)).to_numpy(zero_copy_only=False)
            total += (cells - center) / scale * weight
    return total + intercept


def _line_scores(panel: HeldPanel, fitted: Sequence[Row], model: Transformer, cfg: FeatureConfig, start: str | None, risk: bool) -> DataFrame | None:
    """The output of a linear model for each row of a held panel, or with ``risk`` the statistics of each entity's output, made by the tasks
    that make the features: only the result leaves them. None where :func:`_line_terms` has none."""
    terms = _line_terms(panel, fitted, model, cfg)
    if terms is None:
        return None
    intercept = float(model.stages[1].intercept)
    names = [c for c, term in terms if not isinstance(term, np.ndarray)]
    kind = f"{ENTITY} {panel.rows.schema[ENTITY].dataType.simpleString()}"

    def scores(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _summed(terms, intercept, batch)
        return pa.RecordBatch.from_arrays([batch.column(ENTITY), batch.column(DATE), pa.array(made)], [ENTITY, DATE, PREDICTION])

    def statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
        return series_statistics(batch.column(ENTITY), batch.column("pos").to_numpy(), _summed(terms, intercept, batch))

    if risk:
        return reduced_features(panel, cfg, names, partial(map, statistics), f"{kind}, {STATISTICS}", start)
    return reduced_features(panel, cfg, names, partial(map, scores), f"{kind}, {DATE} date, {PREDICTION} double", start)


def score_batch(panel: DataFrame | HeldPanel, params: DataFrame, model: Transformer, cfg: FeatureConfig) -> DataFrame:
    """``(date, entity, prediction)`` for every entity of the panel, with the fitted columns only.

    The features of a held panel are made and carried forward entity by entity; only its rows are shuffled. A linear model of features that
    need no value of the day itself is applied by the same tasks.
    """
    if isinstance(panel, HeldPanel) and (scored := _line_scores(panel, params.collect(), model, cfg, None, False)) is not None:
        return prediction_rows(scored, PREDICTION)
    return prediction_rows(model.transform(_prepared(panel, params, cfg, None)), PREDICTION)


def score_risk(
    panel: DataFrame | HeldPanel,
    attributes: DataFrame,
    params: DataFrame,
    model: Transformer,
    cfg: FeatureConfig,
    start: str,
) -> DataFrame:
    """Risk of every entity from its predictions on and after ``start``.

    Those of a linear model on a held panel are reduced to the statistics of each entity by the tasks that make them; others are written
    once, as the scores read them several times.
    """
    if isinstance(panel, HeldPanel) and (found := _line_scores(panel, params.collect(), model, cfg, start, True)) is not None:
        return risk_scores(None, attributes, statistics=found)
    predicted = model.transform(_prepared(panel, params, cfg, start)).select(
        ENTITY, DATE, F.col(PREDICTION).alias("predicted")
    )
    predicted = durable(predicted, "predicted")
    return risk_scores(predicted, attributes, "predicted")
