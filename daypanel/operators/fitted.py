"""Steps that learn from training rows and are then applied unchanged: pruning, filling, scaling.

The learned state is a small table with one row per column (``column, dropped, median, center,
scale``). It is bounded by the number of columns, so it may cross the driver; the rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.operators import order, panel, resample, series
from daypanel.operators.features import ROW_FEATURES, FeatureConfig, calendar_days, held_features, made_columns, reduced_features, select_features, value_columns
from daypanel.operators.frames import KNOWN, carry_ordered
from daypanel.schema import BASIN, DATE, ENTITY, TARGET
from daypanel.session import durable

PARAMS_SCHEMA = "column string, place int, dropped boolean, median double, center double, scale double"


# --- pruning -----------------------------------------------------------------------------------


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, known values, whether more than one value occurs. One aggregate over one scan."""
    names = list(columns or value_columns(df))
    measured = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("known"),
                F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varies"),
            ).alias(f"c{i}")
            for i, c in enumerate(names)
        ]
    )
    return measured.select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))


def fit_pruning(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that are empty or hold a single value."""
    return sorted(r["column"] for r in column_profile(df, columns).where(~F.col("varies")).collect())


def fit_sparse(df: DataFrame, max_missing: float = 0.3, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose share of missing values is strictly above the limit."""
    missing = F.try_divide(F.col("rows") - F.col("known"), F.col("rows"))
    return sorted(r["column"] for r in column_profile(df, columns).where(missing > max_missing).collect())


def prune_constant_columns(df: DataFrame, dropped: Sequence[str]) -> DataFrame:
    return df.drop(*dropped)


drop_sparse_columns = prune_constant_columns


def apply_feature_schema(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the fitted columns in their order; a column the data lacks becomes 0."""
    return df.select(
        *keep, *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    )


# --- scaling -----------------------------------------------------------------------------------


def _spread(df: DataFrame, columns: Sequence[str], center, scale) -> DataFrame:
    parts = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), center(c).alias("center"), scale(c).alias("scale")).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    return parts.withColumn("scale", F.when(F.coalesce(F.col("scale"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("scale")))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column; a flat column is divided by 1."""
    return _spread(df, columns, F.avg, F.stddev_pop)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and range per column; a flat column is divided by 1."""
    return _spread(
        df, columns, lambda c: F.min(c).cast("double"), lambda c: (F.max(c) - F.min(c)).cast("double")
    )


def scale_columns(df: DataFrame, params: Sequence) -> DataFrame:
    """``(x - center) / scale`` for each fitted column."""
    known = {p["column"]: p for p in params}
    return df.select(
        *[
            ((F.col(c) - F.lit(known[c]["center"])) / F.lit(known[c]["scale"])).alias(c) if c in known else F.col(c)
            for c in df.columns
        ]
    )


# --- filling -----------------------------------------------------------------------------------


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median of each column over all rows: columns are groups of one distributed selection."""
    return order.column_quantiles(df, columns, {"median": 0.5})


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))).alias(c) if medians.get(c) is not None else F.col(c)
            for c in df.columns
        ]
    )


# --- the whole preparation ---------------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Number of rows, means and summed products of the distances from the means: what least squares needs of the rows."""

    rows: int
    means: np.ndarray
    products: np.ndarray

    def joined(self, other: Moments) -> Moments:
        rows, gap = self.rows + other.rows, other.means - self.means
        means = self.means + gap * (other.rows / rows)
        return Moments(rows, means, self.products + other.products + np.outer(gap, gap) * (self.rows * other.rows / rows))

    def scaled(self, center: np.ndarray, scale: np.ndarray) -> Moments:
        return Moments(self.rows, (self.means - center) / scale, self.products / np.outer(scale, scale))


@dataclass(frozen=True)
class Prepared:
    """Fitted state and the frames it produced."""

    train: DataFrame
    test: DataFrame
    params: DataFrame
    features: list[str]


@dataclass(frozen=True)
class Learned:
    """Fitted state without the rows, and the moments of the prepared features and, last, the target of the training rows."""

    params: DataFrame
    features: list[str]
    moments: Moments


def _moments_of(fills: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.column_stack([pc.fill_null(c, f).to_numpy(zero_copy_only=False) for c, f in zip(batch.columns, fills, strict=True)])
            with np.errstate(invalid="ignore", over="ignore"):
                first = cells[0].copy()
                cells -= first  # so that the products of a flat column are 0
                means = cells.mean(0)
                cells -= means
                own = Moments(len(cells), first + means, cells.T @ cells)
                total = total.joined(own) if total else own
        if total:
            columns = [pa.array([total.rows]), *[pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (total.means, total.products)]]
            yield pa.RecordBatch.from_arrays(columns, ["n", "means", "products"])

    return run


MOMENTS = "n long, means array<double>, products array<double>"


def _total(parts: DataFrame) -> Moments | None:
    """The moments of all rows from one matrix a task; None without rows or where one is not finite."""
    found = sorted(parts.collect(), key=lambda r: (r["n"], r["means"]))
    if not found:
        return None
    size = len(found[0]["means"])
    total = reduce(Moments.joined, [Moments(r["n"], np.array(r["means"]), np.array(r["products"]).reshape(size, size)) for r in found])
    return total if np.isfinite(total.means).all() and np.isfinite(total.products).all() else None


def _learned(carried: DataFrame, inputs: Sequence[str], dropped: set[str], scaling: str) -> list[tuple]:
    """Rows of :data:`PARAMS_SCHEMA` from the training rows with known values carried forward."""
    kept = [c for c in inputs if c not in dropped]
    medians = {r["column"]: r["median"] for r in column_medians(carried, kept).collect()}
    fit = fit_standard if scaling == "standard" else fit_minmax
    spread = {r["column"]: r for r in fit(fill_medians(carried, medians), kept).collect()}
    return [
        (c, i, c in dropped, medians.get(c), *((spread[c]["center"], spread[c]["scale"]) if c in spread else (None, None)))
        for i, c in enumerate(inputs)
    ]


def _fit(train: DataFrame, target: str, max_missing: float, scaling: str, materialize: bool) -> tuple[list[tuple], DataFrame]:
    """Rows of :data:`PARAMS_SCHEMA`, and the training rows with known values carried forward.

    The carried rows are what medians and scaling are learned from and what is filled and scaled afterwards, so they are written once.
    """
    inputs = [c for c in select_features(train) if c != target]
    dropped = set(fit_sparse(train, max_missing, inputs))
    carried = series.ffill(train, [c for c in inputs if c not in dropped])
    if materialize:
        carried = durable(carried, "carried")
    return _learned(carried, inputs, dropped, scaling), carried


def fit_params(
    train: DataFrame, target: str = TARGET, max_missing: float = 0.3, scaling: str = "standard"
) -> DataFrame:
    """Learn which columns to drop, the fill medians (after carrying values forward) and the scaling."""
    rows, _ = _fit(train, target, max_missing, scaling, False)
    return train.sparkSession.createDataFrame(rows, PARAMS_SCHEMA)


def apply_params(df: DataFrame, params: Sequence, keep: Sequence[str], carried: bool = False) -> DataFrame:
    """Carry values forward (unless that is done), fill with the fitted medians and scale; never drops or learns anything."""
    used = sorted((p for p in params if not p["dropped"]), key=lambda p: p["place"])
    names = [p["column"] for p in used]
    carried = df if carried else series.ffill(df, [c for c in names if c in df.columns])
    shaped = apply_feature_schema(carried, names, keep)
    filled = fill_medians(shaped, {p["column"]: p["median"] for p in used})
    return scale_columns(filled, used)


def preprocess(
    df: DataFrame,
    train_end: str | None = None,
    test_start: str | None = None,
    train_start: str | None = None,
    test_end: str | None = None,
    target: str = TARGET,
    max_missing: float = 0.3,
    scaling: str = "standard",
    max_train_rows: int | None = None,
    materialize: bool = True,
    train_fraction: float = 0.8,
    oversample_share: float | None = None,
    seed: int = 42,
) -> Prepared:
    """Valid targets, split by time, optional row cap, then fit on the training rows and apply to both.

    Without both dates the first ``train_fraction`` of the rows in date order are for training. With ``oversample_share`` noisy copies of
    extreme rows are appended to the prepared training rows, marked by ``is_synthetic``; nothing is learned from them. Fitting reads
    the rows several times and training many more, so with ``materialize`` the features, the training rows with values carried
    forward and the prepared training rows are each written once to the shared folder.
    """
    valid = panel.drop_invalid_target(df, target)
    if materialize:
        valid = durable(valid, "features")
    if train_end and test_start:
        train, test = panel.temporal_split(valid, train_end, test_start, train_start, test_end)
    else:
        marked = order.fraction_split(valid, train_fraction)
        marked = durable(marked, "split") if materialize else marked
        train, test = (marked.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    if max_train_rows:
        train = order.stride_sample(train, max_train_rows)
    found, carried = _fit(train, target, max_missing, scaling, materialize)
    params = df.sparkSession.createDataFrame(found, PARAMS_SCHEMA)
    rows = params.collect()
    keep = [c for c in df.columns if c in ("catchment_id", "date", "basin") or c == target]
    features = [r["column"] for r in sorted(rows, key=lambda r: r["place"]) if not r["dropped"]]
    prepared = apply_params(carried, rows, keep, carried=True)
    if oversample_share is not None:
        prepared = resample.oversample_extremes(prepared, features, oversample_share, target, seed)
    return Prepared(durable(prepared, "train") if materialize else prepared, apply_params(test, rows, keep), params, features)


def carried_features(
    held: panel.HeldPanel,
    cfg: FeatureConfig,
    names: Sequence[str],
    keep: Sequence[str],
    since: str | None = None,
    until: str | None = None,
    usable: bool = False,
    counted: Sequence[str] = (),
) -> DataFrame:
    """``keep`` and the named features of a held panel, with known values carried forward over the rows that are returned."""
    rows = held_features(held, cfg, since, until, usable, carried=True, counted=counted)
    known = [c for c in names if c in rows.columns]
    values = held.fields("_seen")
    left = [c for c in known if c in values or c in ROW_FEATURES]  # what the tasks that build the frames do not carry
    return carry_ordered(rows.select(*dict.fromkeys([*keep, *known, *([KNOWN] if counted else [])])), left, ENTITY)


def _counted_sparse(carried: DataFrame, counted: Sequence[str], max_missing: float) -> set[str]:
    """:func:`fit_sparse` of rows whose values were carried since, from the numbers that were counted before."""
    rows = carried.count()
    known = carried.where(F.col(KNOWN).isNotNull()).select(F.posexplode(KNOWN).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    found = {counted[r["at"]]: r["n"] for r in known.collect()}
    return {c for c in counted if rows and (rows - found[c]) / rows > max_missing}


def preprocess_held(
    held: panel.HeldPanel, cfg: FeatureConfig, train_end: str, test_start: str, unused: Sequence[str] = (), max_missing: float = 0.3, scaling: str = "standard"
) -> Prepared:
    """:func:`preprocess` of the features of a held panel, split by time, without the columns ``unused``.

    The features are derived from the held rows entity by entity, those of the training rows once: values are carried forward, and
    counted before that, where they are made, and the carried rows are written. Only the held rows are shuffled. Filling and scaling is an
    expression on the carried rows.
    """
    train = held_features(held, cfg, until=train_end, usable=True).drop(*unused)
    keep = [c for c in train.columns if c in (ENTITY, DATE, BASIN) or c == cfg.target]
    inputs = [c for c in select_features(train) if c != cfg.target]
    own = {*held.fields("_copies"), *held.fields("_seen")}
    counted = [c for c in inputs if c in own or c in made_columns(held, cfg)]  # the others are never NULL, or counted below
    every = durable(carried_features(held, cfg, inputs, keep, until=train_end, usable=True, counted=counted), "carried")
    dropped = _counted_sparse(every, counted, max_missing)
    if single := [c for c in inputs if c in ROW_FEATURES]:
        dropped |= set(fit_sparse(train, max_missing, single))
    carried = every.drop(KNOWN)
    found = _learned(carried, inputs, dropped, scaling)
    params = held.rows.sparkSession.createDataFrame(found, PARAMS_SCHEMA)
    rows = params.collect()
    features = [r["column"] for r in sorted(rows, key=lambda r: r["place"]) if not r["dropped"]]
    test = carried_features(held, cfg, features, keep, since=test_start, usable=True)
    return Prepared(*(apply_params(part, rows, keep, carried=True) for part in (carried, test)), params, features)


def _counting(inputs: Sequence[str], counted: Sequence[str], cells):
    """Rows of :data:`daypanel.operators.order.RANGES` of each column of a task; without a range, how many values a column had before any
    was carried, and without a column, the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = 0, np.zeros(len(counted), np.int64)

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal rows, known
            for batch in batches:
                rows += batch.num_rows
                for n in batch.column(KNOWN).drop_null().to_pylist():
                    known += np.array(n, np.int64)
                yield cells(batch)

        yield from order.range_counts(inputs)(seen())
        names = [*counted, None]
        columns = [pa.array(names, pa.string()), pa.nulls(len(names), pa.int32()), pa.array([*known.tolist(), rows])]
        yield pa.RecordBatch.from_arrays(columns, ["column", "_range", "_rows"])

    return run


def learn_held(held: panel.HeldPanel, cfg: FeatureConfig, train_end: str, unused: Sequence[str] = (), max_missing: float = 0.3) -> Learned | None:
    """What :func:`preprocess_held` learns with standard scaling, without the prepared rows, and what a linear model needs of them.

    The features of the training rows are made three times, and reduced by the tasks that make them: to counts by value range, to the
    values of the ranges that hold a median, and to one matrix a task. No training row is written or leaves its task. None where an input
    needs the value of its day, or a moment is not finite.
    """
    train = held_features(held, cfg, until=train_end, usable=True).drop(*unused)
    inputs = [c for c in select_features(train) if c != cfg.target]
    dated = calendar_days(held, cfg)
    made = {*held.fields("_copies"), *made_columns(held, cfg)}
    by_day = {c: np.array([]) for c in inputs if c not in made and c in dated.columns}
    counted = [c for c in inputs if c in made]
    if set(inputs) != {*by_day, *counted}:
        return None
    days = dated.orderBy("pos").collect()
    by_day = {c: np.array([r[c] for r in days], float) for c in by_day}

    def cells_of(names: Sequence[str]):
        def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
            day = batch.column("pos").to_numpy() - 1
            return pa.RecordBatch.from_arrays([pa.array(by_day[c][day]) if c in by_day else pc.cast(batch.column(c), pa.float64()) for c in names], list(names))

        return cells

    def scan(names: Sequence[str], then, schema: str, counted: Sequence[str] = ()) -> DataFrame:
        return reduced_features(held, cfg, [c for c in names if c not in by_day], then, schema, None, train_end, True, counted)

    def mapped(names: Sequence[str]):
        cells = cells_of(names)
        return lambda run, schema: scan(names, lambda batches: run(map(cells, batches)), schema)

    counts = scan(inputs, _counting(inputs, counted, cells_of(inputs)), order.RANGES, counted)
    counts = durable(counts.groupBy("column", "_range").agg(F.sum("_rows").alias("_rows")), "ranges")
    known = {r["column"]: r["_rows"] for r in counts.where(F.col("_range").isNull()).collect()}
    rows = known.get(None, 0)
    dropped = {c for c in counted if rows and (rows - known[c]) / rows > max_missing}
    kept = [c for c in inputs if c not in dropped]
    ranges = counts.where(F.col("_range").isNotNull() & F.col("column").isin(kept))
    medians = {r["column"]: r["median"] for r in order.ranged_quantiles(ranges, mapped(kept), kept, {"median": 0.5}).collect()}
    if any(medians.get(c) is None for c in kept):
        return None
    total = _total(mapped([*kept, cfg.target])(_moments_of([*[float(medians[c]) for c in kept], 0.0]), MOMENTS))
    if total is None:
        return None
    center = np.append(total.means[:-1], 0.0)
    scale = np.sqrt(np.append(total.products.diagonal()[:-1] / total.rows, 1.0))
    scale[scale == 0] = 1.0
    spread = {c: (float(center[i]), float(scale[i])) for i, c in enumerate(kept)}
    found = [(c, i, c in dropped, medians.get(c), *spread.get(c, (None, None))) for i, c in enumerate(inputs)]
    return Learned(held.rows.sparkSession.createDataFrame(found, PARAMS_SCHEMA), kept, total.scaled(center, scale))
