"""Validation on held-out entities: train on all others, score the one left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.modelling.search import PREDICTION, model_stages
from daypanel.operators.fitted import fit_standard, scale_columns
from daypanel.operators.order import attach
from daypanel.operators.panel import drop_invalid_target
from daypanel.operators.scores import metric_suite
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PRED, TARGET
from daypanel.session import durable

MIN_TEST, MIN_TRAIN = 30, 100
#: Numbers that a task holds before it hands its sums on.
HELD_NUMBERS = 4_000_000


def _fold_table(rows: DataFrame) -> DataFrame:
    """The suite of each held-out entity with its size and group."""
    suite = metric_suite(rows, [ENTITY], count="n_test")
    if BASIN in rows.columns:
        suite = suite.join(rows.groupBy(ENTITY).agg(F.first(BASIN, ignorenulls=True).alias(BASIN)), ENTITY)
    return suite.withColumnRenamed(ENTITY, "held_out")


def _large_enough(stats: DataFrame, total: DataFrame) -> DataFrame:
    sized = attach(stats, total)
    return sized.where((F.col("n") >= MIN_TEST) & (F.col("n_all") - F.col("n") >= MIN_TRAIN))


def leave_one_out_mean(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Each entity predicted by the mean of all others: totals minus its own sums, one pass for all folds."""
    rows = drop_invalid_target(df, target)
    own = rows.groupBy(ENTITY).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    total = own.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    means = _large_enough(own, total).select(
        ENTITY, F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n")).alias(PRED)
    )
    keep = [ENTITY, DATE, *([BASIN] if BASIN in df.columns else [])]
    return _fold_table(rows.select(*keep, F.col(target).alias(OBS)).join(means, ENTITY))


def _sums_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, counts, sums = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["key", "n", "sums"]
    )


def _gram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each entity its rows and the sums of products of (1, inputs, target) that the task has seen, as one packed matrix."""
    held: dict = {}
    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(0).type
        coded = batch.column(0).dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        table = np.stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]], 1)
        order = np.argsort(code, kind="stable")
        edges = np.flatnonzero(np.diff(code[order])) + 1
        for part in np.split(order, edges):
            rows = table[part]
            name, sums = names[code[part[0]]], (rows.T @ rows).ravel()
            n, before = held.get(name, (0, 0.0))
            held[name] = n + len(part), before + sums
        if len(held) * table.shape[1] ** 2 > HELD_NUMBERS:
            yield _sums_batch([(k, n, s) for k, (n, s) in held.items()], kind)
            held = {}
    if held:
        yield _sums_batch([(k, n, s) for k, (n, s) in held.items()], kind)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of one key."""
    key, n, sums, kind = None, 0, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for k, m, s in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sums")), strict=True):
            if sums is not None and k != key:
                yield _sums_batch([(key, n, sums)], kind)
                n, sums = 0, None
            key, n, sums = k, n + m, np.array(s) if sums is None else sums + np.array(s)
    if sums is not None:
        yield _sums_batch([(key, n, sums)], kind)


def _solving(total: np.ndarray, rows: int, size: int):
    """Coefficients of the least squares without each entity, by subtraction from the sums of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weights = [], []
            for key, n, sums in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sums")), strict=True):
                if n >= MIN_TEST and rows - n >= MIN_TRAIN:
                    rest = (total - np.array(sums)).reshape(size + 1, size + 1)
                    keys.append(key)
                    weights.append(np.linalg.lstsq(rest[:size, :size], rest[:size, size], rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(weights, pa.list_(pa.float64()))], [ENTITY, "weights"]
            )

    return run


def leave_one_out_linear(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Least squares with each entity left out, without refitting on the rows.

    The normal equations of a fold are those of all entities minus those of the held-out one. A task multiplies the rows of each of its
    entities as matrices and hands on one packed matrix an entity; these are added by entity, so an entity of any size is one row a
    task. The driver adds one matrix a partition; the small systems are solved in tasks and the coefficients joined back.
    """
    rows = drop_invalid_target(df, target).dropna(subset=[ENTITY, *features])
    # Centring and scaling does not change least-squares predictions; it keeps the sums well conditioned.
    scaled = scale_columns(rows, fit_standard(rows, features).collect())
    size, id_type = len(features) + 1, dict(df.dtypes)[ENTITY]
    schema = f"key {id_type}, n long, sums array<double>"
    packed = scaled.select(F.col(ENTITY).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*features, target])])
    own = packed.mapInArrow(_gram_sums, schema).repartition("key").sortWithinPartitions("key").mapInArrow(_added, schema)
    own = durable(own, "grams")
    parts = own.select(F.lit(0).alias("key"), "n", "sums").mapInArrow(_added, "key int, n long, sums array<double>").collect()  # one row a partition
    total = sum((np.array(r["sums"]) for r in sorted(parts, key=lambda r: r["sums"])), np.zeros((size + 1) ** 2))
    weights = own.mapInArrow(_solving(total, sum(r["n"] for r in parts), size), f"{ENTITY} {id_type}, weights array<double>")
    value = F.col("weights")[0]
    for i, c in enumerate(features):
        value = value + F.col("weights")[i + 1] * F.col(c)
    keep = [ENTITY, DATE, *([BASIN] if BASIN in df.columns else [])]
    predicted = scaled.join(weights, ENTITY).select(*keep, F.col(target).alias(OBS), value.alias(PRED))
    return _fold_table(predicted)


def grouped_folds(
    df: DataFrame,
    factory: Callable[[], Estimator],
    features: Sequence[str],
    folds: int = 5,
    target: str = TARGET,
    scale: bool = True,
    parallelism: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Every entity predicted by a model that has not seen it, for any estimator and any number of entities.

    Entities are dealt to ``folds`` parts by the hash of their id and each part is predicted by a model of the others: ``folds`` fits
    however many entities there are, and no list of them on the driver. Predictions are written by tasks and scored by entity.
    """
    rows = drop_invalid_target(df, target).dropna(subset=[ENTITY, *features])
    keep = [ENTITY, DATE, *([BASIN] if BASIN in df.columns else [])]
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(ENTITY)), F.lit(folds)).cast("int").alias("fold")
    dealt = durable(rows.select(*dict.fromkeys([*keep, target, *features]), part), "dealt")

    def fold(number: int) -> DataFrame | None:
        train, test = dealt.where(F.col("fold") != number), dealt.where(F.col("fold") == number)
        if train.limit(MIN_TRAIN).count() < MIN_TRAIN or test.isEmpty():
            return None
        if scale:
            params = fit_standard(train, features).collect()
            train, test = scale_columns(train, params), scale_columns(test, params)
        model = model_stages(factory(), features, target).fit(train)
        return durable(model.transform(test).select(*keep, F.col(target).alias(OBS), F.col(PREDICTION).alias(PRED)), "fold")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = [p for p in pool.map(fold, range(folds)) if p is not None]
    empty = dealt.select(*keep, F.col(target).alias(OBS), F.lit(0.0).alias(PRED)).limit(0)
    return _fold_table(reduce(DataFrame.unionByName, parts, empty)).where(F.col("n_test") >= MIN_TEST)


def leave_one_entity_out(
    df: DataFrame,
    factory: Callable[[], Estimator],
    features: Sequence[str],
    target: str = TARGET,
    max_entities: int | None = None,
    scale: bool = True,
    parallelism: int = 2,
) -> DataFrame:
    """The same folds for any estimator: one fit per entity, submitted side by side as Spark jobs.

    Meant for estimators without a closed form and a moderate number of entities; see :func:`leave_one_out_linear` for one scan over
    any number of them, and :func:`grouped_folds` for any estimator over any number of them.
    """
    rows = drop_invalid_target(df, target).dropna(subset=list(features))
    sizes = rows.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("n_all"))
    chosen = _large_enough(sizes, total).orderBy(ENTITY)
    ids = [r[ENTITY] for r in (chosen.limit(max_entities) if max_entities else chosen).collect()]
    keep = [ENTITY, DATE, *([BASIN] if BASIN in df.columns else [])]

    def fold(held_out) -> list:
        train, test = rows.where(F.col(ENTITY) != held_out), rows.where(F.col(ENTITY) == held_out)
        if scale:
            params = fit_standard(train, features).collect()
            train, test = scale_columns(train, params), scale_columns(test, params)
        model = model_stages(factory(), features, target).fit(train)
        predicted = model.transform(test).select(*keep, F.col(target).alias(OBS), F.col(PREDICTION).alias(PRED))
        return _fold_table(predicted).collect()

    with ThreadPoolExecutor(parallelism) as pool:
        results = [r for part in pool.map(fold, ids) for r in part]
    empty = rows.select(*keep, F.col(target).alias(OBS), F.lit(0.0).alias(PRED)).limit(0)
    return df.sparkSession.createDataFrame(results, _fold_table(empty).schema)
