"""Model families, hyper-parameter trials and time-ordered validation."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.functions.errors import Errors
from daypanel.operators.compare import pick_best_model
from daypanel.operators.fitted import Moments
from daypanel.operators.order import time_series_folds
from daypanel.schema import TARGET
from daypanel.session import durable

PREDICTION = "prediction"

# Name -> (estimator factory, parameter search space).
FAMILIES: dict[str, Callable[[Mapping], Estimator]] = {
    "linear": lambda p: LinearRegression(**p),
    "random_forest": lambda p: RandomForestRegressor(seed=42, **p),
    "boosted_trees": lambda p: GBTRegressor(seed=42, **p),
}

SEARCH_SPACES: dict[str, dict[str, dict]] = {
    "linear": {
        "regParam": {"type": "float", "low": 0.0001, "high": 10.0, "log": True},
        "elasticNetParam": {"type": "float", "low": 0.0, "high": 1.0},
    },
    "random_forest": {
        "numTrees": {"type": "int", "low": 100, "high": 400},
        "maxDepth": {"type": "int", "low": 5, "high": 25},
        "minInstancesPerNode": {"type": "int", "low": 1, "high": 10},
        "featureSubsetStrategy": {"type": "categorical", "choices": ["sqrt", "log2", "0.5"]},
    },
    "boosted_trees": {
        "maxIter": {"type": "int", "low": 100, "high": 1000},
        "maxDepth": {"type": "int", "low": 3, "high": 15},
        "stepSize": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
        "subsamplingRate": {"type": "float", "low": 0.6, "high": 1.0},
        "minInstancesPerNode": {"type": "int", "low": 5, "high": 50},
    },
}


def draw_params(space: Mapping[str, Mapping], rng: random.Random, include_high: bool = False) -> dict:
    """One point of the space; integers from ``[low, high)`` unless ``include_high``."""
    out = {}
    for name, spec in space.items():
        kind = spec["type"]
        if kind == "int":
            out[name] = rng.randrange(spec["low"], spec["high"] + (1 if include_high else 0))
        elif kind == "float" and spec.get("log"):
            out[name] = math.exp(rng.uniform(math.log(spec["low"]), math.log(spec["high"])))
        elif kind == "float":
            out[name] = rng.uniform(spec["low"], spec["high"])
        elif kind == "categorical":
            out[name] = spec["choices"][rng.randrange(len(spec["choices"]))]
        else:
            raise ValueError(f"unknown parameter type: {kind}")
    return out


def trial_table(space: Mapping[str, Mapping], n: int, seed: int = 42, include_high: bool = False) -> list[dict]:
    """The ``n`` parameter sets to try, the same for every run with one seed."""
    rng = random.Random(seed)
    return [draw_params(space, rng, include_high) for _ in range(n)]


def model_stages(estimator: Estimator, features: Sequence[str], target: str = TARGET) -> Pipeline:
    """Vector assembly and the estimator; rows with a missing input are an error, so clean first."""
    estimator = estimator.copy()
    estimator.setFeaturesCol("features").setLabelCol(target).setPredictionCol(PREDICTION)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def fit_moments(spark: SparkSession, moments: Moments, estimator: LinearRegression, features: Sequence[str], target: str = TARGET) -> PipelineModel:
    """:func:`model_stages` of a linear model, fitted to the moments of its training rows: of ``features`` and, last, the target.

    Least squares, with any penalty, sees only the means and covariances of the rows. The model is fitted to as few rows as have the same:
    the mean moved both ways along each axis of the covariance. Its summary counts these rows. Without a penalty an input that is flat or
    determined by those before it is left out, which changes no prediction: MLlib could solve for it only by iteration.
    """
    spread = np.sqrt(moments.products.diagonal() / moments.rows)
    unit = np.where(spread > 0, spread, 1.0)
    sizes, axes = np.linalg.eigh(moments.products / moments.rows / np.outer(unit, unit))
    moves = (axes * np.sqrt(np.maximum(sizes, 0.0) * len(sizes))).T * np.where(spread > 0, unit, 0.0)
    rows = np.concatenate([moments.means + moves, moments.means - moves])
    schema = ", ".join(f"`{c}` double" for c in [*features, target])
    used = features if estimator.getRegParam() else _independent(moments.products / np.outer(unit, unit) / moments.rows, features)
    return model_stages(estimator, used or features, target).fit(spark.createDataFrame(rows.tolist(), schema).coalesce(1))


def _independent(correlations: np.ndarray, names: Sequence[str]) -> list[str]:
    """The names whose column is not a linear combination of those before it."""
    left, found = correlations.copy(), []
    for i, name in enumerate(names):
        if left[i, i] > 1e-10:
            found.append(name)
            left -= np.outer(left[:, i], left[i]) / left[i, i]
    return found


def nse_score(target: str = TARGET, prediction: str = PREDICTION) -> Column:
    """The default scorer: NSE of the raw predictions as an aggregate expression."""
    return Errors(target, prediction).nse()


def cv_score(
    folded: DataFrame,
    estimator: Estimator,
    features: Sequence[str],
    folds: int,
    target: str = TARGET,
    scorer: Column | None = None,
) -> list[float]:
    """Score of each validation fold. A fold's model sees only real or synthetic rows that lie before
    the fold; synthetic rows (``is_synthetic``) are never validated on."""
    return [_fold_score(folded, estimator, features, i, target, scorer) for i in range(folds)]


def _fold_score(folded, estimator, features, i, target, scorer):
    scorer = nse_score(target) if scorer is None else scorer
    real = ~F.col("is_synthetic") if "is_synthetic" in folded.columns else F.lit(True)
    train = folded.where(F.col("fold").isNull() | (F.col("fold") < i))
    model = model_stages(estimator, features, target).fit(train)
    return model.transform(folded.where((F.col("fold") == i) & real)).agg(scorer.alias("s")).head()["s"]


@dataclass
class Search:
    """What a search tried and found. ``trials`` has a row per trial; failed trials have no score."""

    trials: DataFrame
    best_model_name: str | None
    best_params: dict
    best_score: float | None
    model: PipelineModel | None
    results: dict = field(default_factory=dict)


TRIAL_SCHEMA = (
    "place int, model string, trial int, params map<string,string>, fold_scores array<double>, "
    "score double, seconds double, error string"
)


#: Training rows that one task of a fit is worth; more tasks for fewer rows cost more than they save.
TASK_ROWS = 200_000


def _timed_fold(folded, make, features, i, target, scorer, params):
    """Score, seconds and error of one fold of a trial."""
    started = time.monotonic()
    try:
        return _fold_score(folded, make(params), features, i, target, scorer), time.monotonic() - started, None
    except Exception as failure:  # a bad parameter set is recorded and the search goes on
        return None, time.monotonic() - started, str(failure)[:500]


def _trial_row(place, family, trial, params, tried):
    scores, error = [s for s, _, _ in tried], next((e for _, _, e in tried if e is not None), None if tried else "no folds")
    if error is None:
        undefined = [i for i, s in enumerate(scores) if s is None]
        error = f"no score in folds {undefined}" if undefined else None
    else:
        scores = None
    score = sum(scores) / len(scores) if error is None else None
    shown = {k: str(v) for k, v in params.items()}
    return (place, family, trial, shown, scores, score, sum(t for _, t, _ in tried), error)


def _run_trials(folded, trials, features, folds, target, scorer, factories, parallelism):
    """Rows of :data:`TRIAL_SCHEMA` of ``(place, family, trial, params)``.

    All folds of all trials wait in one line: the last folds, which learn from most rows, and the last families first.
    """
    with ThreadPoolExecutor(parallelism) as pool:
        jobs = {
            (t, i): pool.submit(_timed_fold, folded, factories[family], features, i, target, scorer, params)
            for i in reversed(range(folds))
            for t, (_, family, _, params) in reversed(list(enumerate(trials)))
        }
        return [_trial_row(*trial, [jobs[t, i].result() for i in range(folds)]) for t, trial in enumerate(trials)]


def param_search(
    folded: DataFrame,
    family: str,
    features: Sequence[str],
    folds: int,
    params: Sequence[Mapping],
    target: str = TARGET,
    scorer: Column | None = None,
    factories: Mapping[str, Callable[[Mapping], Estimator]] = FAMILIES,
    adjust: Callable[[dict], dict] | None = None,
    parallelism: int = 2,
    first_place: int = 0,
) -> list[tuple]:
    """Rows of :data:`TRIAL_SCHEMA`, one per parameter set. Folds of trials are Spark jobs submitted side by side."""
    trials = _trials(family, params, adjust, first_place)
    return _run_trials(folded, trials, features, folds, target, scorer, factories, parallelism)


def _trials(family, params, adjust, first_place):
    return [(first_place + i, family, i, adjust(dict(p)) if adjust else dict(p)) for i, p in enumerate(params)]


def fit_models(
    train: DataFrame,
    features: Sequence[str],
    folds: int = 3,
    n_trials: int = 5,
    target: str = TARGET,
    families: Sequence[str] = tuple(FAMILIES),
    spaces: Mapping[str, Mapping] = SEARCH_SPACES,
    factories: Mapping[str, Callable[[Mapping], Estimator]] = FAMILIES,
    base: Mapping[str, Mapping] | None = None,
    scorer: Column | None = None,
    adjust: Callable[[dict], dict] | None = None,
    seed: int = 42,
    parallelism: int | None = None,
    whole_days: bool = True,
    refit: bool = True,
    include_high: bool = False,
) -> Search:
    """Search every family over the same time folds, keep the best parameters and refit them on all rows.

    The folds are written once, so that the many small jobs of a fit do not carry the history of the rows. Rows that fill few tasks
    (:data:`TASK_ROWS`) are read in as few, which leaves cores to other fits: by default as many go side by side as fill the cores, two at least.
    """
    spark = train.sparkSession
    columns = [c for c in ("catchment_id", "date", "is_synthetic", target) if c in train.columns]
    rows = train.select(*columns, *features)
    folded = durable(time_series_folds(rows, folds, whole_days=whole_days), "folds")
    tasks = max(1, math.ceil(folded.count() / TASK_ROWS))
    folded = folded.coalesce(tasks)
    planned: list[tuple] = []
    sets: dict[int, dict] = {}
    for family in families:
        fixed = dict((base or {}).get(family, {}))
        drawn = [{**fixed, **p} for p in trial_table(spaces[family], n_trials, seed, include_high)]
        sets.update({len(planned) + i: p for i, p in enumerate(drawn)})
        planned += _trials(family, drawn, adjust, len(planned))
    side = parallelism or max(2, spark.sparkContext.defaultParallelism // tasks)
    tried = _run_trials(folded, planned, features, folds, target, scorer, factories, side)
    trials = spark.createDataFrame(tried, TRIAL_SCHEMA)
    best = pick_best_model(trials).head()
    results = {}
    for family in families:
        own = [t for t in tried if t[1] == family]
        results[family] = {
            "best_score": max((t[5] for t in own if t[5] is not None), default=None),
            "seconds": sum(t[6] for t in own),
            "errors": sorted({t[7] for t in own if t[7]}),
        }
    if best is None or best["model"] is None:
        raise RuntimeError("all trials failed: " + "; ".join(sorted({t[7] for t in tried if t[7]}))[:500])
    chosen = sets[best["place"]]
    chosen = adjust(dict(chosen)) if adjust else chosen
    model = model_stages(factories[best["model"]](chosen), features, target).fit(folded) if refit else None
    return Search(trials, best["model"], chosen, best["score"], model, results)
