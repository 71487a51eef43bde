"""Feature engineering on the panel: one block layout, one window, a few wide selects."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from daypanel.functions import scalar as S
from daypanel.operators import series
from daypanel.operators.frames import calendar_frames
from daypanel.operators.order import with_position
from daypanel.operators.panel import HeldPanel
from daypanel.schema import DATE, ENTITY, KEYS, NOT_FEATURES, PET, PRECIP, TARGET, TMAX, TMIN


@dataclass(frozen=True)
class FeatureConfig:
    """Which features to build. ``include_current=False`` keeps the target of day t out of every
    feature of day t; the default form includes it and must not be used to judge forecasts."""

    target: str = TARGET
    precip: str = PRECIP
    lags: tuple[int, ...] = (1, 2, 3, 5, 7, 14, 30)
    windows: tuple[int, ...] = (3, 7, 14, 30)
    stats: tuple[str, ...] = ("mean", "std", "min", "max")
    covariates: tuple[str, ...] = (
        "precipitation_mm",
        "temperature_max_c",
        "temperature_min_c",
        "relative_humidity_pct",
        "wind_speed_ms",
        "solar_radiation_wm2",
        "pet_mm",
    )
    covariate_lags: tuple[int, ...] = (1, 3, 7)
    sum_windows: tuple[int, ...] = (3, 7, 14, 30)
    encode: str = "cyclical"
    include_current: bool = True
    warmup: int | None = field(default=None)

    @property
    def warmup_rows(self) -> int:
        return max(self.lags + self.windows) if self.warmup is None else self.warmup


def _change_columns(cfg: FeatureConfig, w: WindowSpec) -> list[Column]:
    """Day-to-day change of the target; one day older when the current day is not to be used."""
    back = 0 if cfg.include_current else 1
    now = F.lag(cfg.target, back).over(w) if back else F.col(cfg.target)
    before = F.lag(cfg.target, back + 1).over(w)
    return [
        (now - before).alias("streamflow_change"),
        S.bounded_change(now, before).alias("streamflow_pct_change"),
    ]


def window_columns(df: DataFrame, cfg: FeatureConfig, w: WindowSpec) -> list[Column]:
    """Every feature that looks back to single rows, all over the same window."""
    has = set(df.columns)
    out: list[Column] = []
    if cfg.target in has:
        out += series.lag_columns(cfg.target, cfg.lags, w)
        out += _change_columns(cfg, w)
    for name in cfg.covariates:
        if name in has:
            out += series.lag_columns(name, cfg.covariate_lags, w)
    return out


def window_frames(df: DataFrame, cfg: FeatureConfig) -> list[series.Frame]:
    """Every feature of trailing rows."""
    out: list[series.Frame] = []
    if cfg.target in df.columns:
        out += series.rolling_frames(cfg.target, cfg.windows, cfg.stats, cfg.include_current)
    if cfg.precip in df.columns:
        out += series.rolling_frames(cfg.precip, cfg.windows, cfg.stats)
        out += series.cumulative_frames(cfg.precip, cfg.sum_windows)
        out.append(series.dry_day_frame(cfg.precip))
    return out


def row_columns(df: DataFrame, cfg: FeatureConfig) -> list[Column]:
    """Features of a single row: season, temperature, water balance and rain."""
    has = set(df.columns)
    day = F.col(DATE)
    out = list(S.seasonal_cyclical(day) if cfg.encode == "cyclical" else S.seasonal_raw(day))
    out += S.season_flags(day)
    if TMAX in has and TMIN in has:
        out += S.temp_features(F.col(TMAX), F.col(TMIN))
    if cfg.precip in has and PET in has:
        out += S.water_balance(F.col(cfg.precip), F.col(PET))
    if cfg.precip in has:
        out += S.rain_features(F.col(cfg.precip))
    return out


def change_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    return series.over_series(df, lambda w: _change_columns(cfg, w), before=2)


def _shifts(df: DataFrame, cfg: FeatureConfig) -> list[series.Frame]:
    """The row shifts of double columns and what the change of the target needs of them, as frames: a task that builds the trailing
    frames takes them from the same arrays."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    out = [(cfg.target, k, f"{cfg.target}_lag_{k}") for k in cfg.lags]
    back = 0 if cfg.include_current else 1
    out += [(cfg.target, back, "_now"), (cfg.target, back + 1, "_before")]
    out += [(c, k, f"{c}_lag_{k}") for c in cfg.covariates for k in cfg.covariate_lags]
    return [series.Frame(c, "lag", 1, name, k) for c, k, name in out if c in doubles]


def engineer_features(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), dealt: bool = False, wanted: Column | None = None) -> DataFrame:
    """All features of all entities, without the warm-up rows. Constant columns are pruned by a
    fitted step (:func:`daypanel.operators.fitted.fit_pruning`), so that scoring never drops columns.

    ``dealt``: see :func:`daypanel.operators.series.over_series`; the rows then stand by entity and day in each partition. Of all
    rows only those for which ``wanted`` is true are returned, if it is given; the others are seen by the frames of later rows.
    """
    given = "pos" in df.columns
    if given:
        placed = df
    elif dealt:
        placed = series.placed_dealt(df)
    else:
        placed = with_position(df)
    reach = max(2, *cfg.lags, *cfg.covariate_lags)
    keep = F.col("pos") > cfg.warmup_rows
    keep = keep if wanted is None else keep & wanted
    shifts, frames = _shifts(df, cfg), window_frames(df, cfg)
    shifted, doubles = {f.name for f in shifts}, {f.column for f in shifts}
    order: list[str] = []

    def others(w: WindowSpec) -> list[Column]:
        """The row shifts of columns of other types, over a window."""
        columns = []
        order.clear()
        if cfg.target in df.columns:
            order.extend([*[f"{cfg.target}_lag_{k}" for k in cfg.lags], "streamflow_change", "streamflow_pct_change"])
            if "_now" not in shifted:
                columns += [*series.lag_columns(cfg.target, cfg.lags, w), *_change_columns(cfg, w)]
        for name in cfg.covariates:
            if name in df.columns:
                order.extend(f"{name}_lag_{k}" for k in cfg.covariate_lags)
                columns += [] if name in doubles else series.lag_columns(name, cfg.covariate_lags, w)
        return columns

    framed = series.over_series(placed, others, before=reach, frames=[*shifts, *frames], dealt=dealt, keep=keep)
    if "_now" in shifted:
        now, before = F.col("_now"), F.col("_before")
        framed = framed.withColumns({"streamflow_change": now - before, "streamflow_pct_change": S.bounded_change(now, before)})
    wide = framed.select(*placed.columns, *order, *[f.name for f in frames], *row_columns(df, cfg))
    return wide if given else wide.drop("pos")


#: Features of a single row that can be NULL.
ROW_FEATURES = ("temperature_range_c", "temperature_mean_c", "precip_pet_ratio", "water_balance_mm")


def _changes(cells: dict[str, tuple], bound: float = 10.0) -> dict[str, tuple]:
    """The cells of the frames with the changes of the target, as :func:`_change_columns` defines them, instead of what they are made of."""
    cells = dict(cells)
    if "_now" not in cells:
        return cells
    (now, no_now), (before, no_before) = cells.pop("_now"), cells.pop("_before")
    null, zero = no_now | no_before, before == 0
    share = np.divide(now, before, out=np.ones(len(now)), where=~zero) - 1
    share = np.where(zero, np.where(now < 0, -bound, bound), np.fmin(np.maximum(share, -bound), bound))
    return cells | {"streamflow_change": (now - before, null), "streamflow_pct_change": (share, null | (zero & (now == 0)))}


def _held_frames(panel: HeldPanel, cfg: FeatureConfig):
    attributes, values = panel.fields("_copies"), panel.fields("_seen")
    attributes.pop("_there", None)
    wanted = [c for c in (cfg.target, *cfg.covariates, cfg.precip) if values.get(c, "double") != "double"]
    if wanted:
        raise ValueError(f"columns that are not double: {wanted}")
    shape = ", ".join([f"{ENTITY} int", f"{DATE} date", *[f"`{c}` {t}" for c, t in (attributes | values).items()]])
    empty = panel.rows.sparkSession.createDataFrame([], shape)
    return attributes, values, empty, [*_shifts(empty, cfg), *window_frames(empty, cfg)]


def made_columns(panel: HeldPanel, cfg: FeatureConfig) -> dict[str, str]:
    """The features of earlier rows of a held panel with their types."""
    _, values, _, frames = _held_frames(panel, cfg)
    made = [(f.name, f.sql_type) for f in frames if f.name not in ("_now", "_before")]
    if cfg.target in values:
        made[len(cfg.lags) : len(cfg.lags)] = [("streamflow_change", "double"), ("streamflow_pct_change", "double")]
    return dict(made)


def held_features(
    panel: HeldPanel, cfg: FeatureConfig = FeatureConfig(), since: str | None = None, until: str | None = None, usable: bool = False, carried: bool = False,
    counted: Sequence[str] = (),
) -> DataFrame:
    """The columns of :func:`engineer_features` for a panel that is held one row an entity, made by one task an entity without a row for
    each day before them. ``since``, ``until`` and ``usable`` (a target that is known and not negative) choose the rows that are returned.

    ``carried`` carries known values of the features of earlier rows forward over the returned rows of each entity; columns of a single
    row are left as they are. ``counted``: see :func:`daypanel.operators.frames.calendar_frames`.
    """
    attributes, values, empty, frames = _held_frames(panel, cfg)
    made = made_columns(panel, cfg)
    key = (ENTITY, panel.rows.schema[ENTITY].dataType.simpleString())
    names = [key, (DATE, "date"), *attributes.items(), ("pos", "int"), *values.items(), *made.items()]
    framed = calendar_frames(
        panel.rows, frames, _changes, names, panel.start, panel.end, ENTITY, cfg.warmup_rows, since, until, cfg.target if usable else None, carried, counted
    )
    return framed.select("*", *row_columns(empty, cfg)).drop("pos")


def day_columns(cfg: FeatureConfig, days: DataFrame) -> list[Column]:
    """The features of :func:`row_columns` that follow from the day alone."""
    return row_columns(days.select(DATE), cfg)


def calendar_days(panel: HeldPanel, cfg: FeatureConfig) -> DataFrame:
    """The days of the calendar with their position and the features of :func:`day_columns`."""
    first = F.lit(panel.start).cast("date")
    length = F.greatest(F.datediff(F.lit(panel.end).cast("date"), first) + 1, F.lit(0))
    days = panel.rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), length)).alias("pos")).where(F.lit(panel.start) <= F.lit(panel.end))
    days = days.withColumn(DATE, F.date_add(first, F.col("pos") - 1))
    return days.select("pos", *day_columns(cfg, days))


def reduced_features(
    panel: HeldPanel, cfg: FeatureConfig, names: Sequence[str], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
    since: str | None = None, until: str | None = None, usable: bool = False, counted: Sequence[str] = (),
) -> DataFrame:
    """What ``then`` makes of the batches of whole entities of :func:`held_features`, carried forward, in the task that makes them.

    A batch has the entity, the day, the position and of the attributes, the values and the features of earlier rows those in ``names``, so
    that no row leaves a task before it is reduced. The other arguments are those of :func:`held_features`.
    """
    attributes, values, _, frames = _held_frames(panel, cfg)
    kinds = attributes | values | made_columns(panel, cfg)
    key = (ENTITY, panel.rows.schema[ENTITY].dataType.simpleString())
    shown = [key, (DATE, "date"), ("pos", "int"), *[(c, kinds[c]) for c in names]]
    wanted = cfg.target if usable else None
    return calendar_frames(panel.rows, frames, _changes, shown, panel.start, panel.end, ENTITY, cfg.warmup_rows, since, until, wanted, True, counted, (then, schema))


def select_features(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that may be model inputs."""
    numeric = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in exclude and f.name != "pos"]


def value_columns(df: DataFrame) -> list[str]:
    """Columns a fitted step may drop: everything but the keys and the position."""
    return [c for c in df.columns if c not in KEYS and c != "pos"]
