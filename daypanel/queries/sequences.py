"""Lags, rolling frames, gap filling, runs and features along each entity's series."""

from __future__ import annotations

from pyspark.sql import functions as F

from daypanel.functions import scalar as S
from daypanel.functions.errors import Errors
from daypanel.operators import baseflow as B
from daypanel.operators import features as FE
from daypanel.operators import order, series
from daypanel.operators.scores import scored
from daypanel.queries import shared as X
from daypanel.queries.registry import query, rounded, rounded_sql, with_
from daypanel.schema import DATE, ENTITY, OBS, PRECIP, PRED, TARGET, TMAX, TMIN

W = "OVER (PARTITION BY catchment_id ORDER BY date)"
LAGS = (1, 2, 3, 5, 7, 14, 30)
WINDOWS = (3, 7, 14, 30)


def _frame(n: int, current: bool = True) -> str:
    edge = f"{n - 1} PRECEDING AND CURRENT ROW" if current else f"{n} PRECEDING AND 1 PRECEDING"
    return f"OVER (PARTITION BY catchment_id ORDER BY date ROWS BETWEEN {edge})"


def _lag_sql(c: str, lags) -> list[str]:
    return [f"LAG({c}, {k}) {W} AS {c}_lag_{k}" for k in lags]


SQL_STATS = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}


def _roll_sql(c: str, windows, stats, current: bool = True) -> list[str]:
    return [f"{SQL_STATS[s]}({c}) {_frame(n, current)} AS {c}_roll{n}_{s}" for n in windows for s in stats]


def _sum_sql(c: str, windows) -> list[str]:
    return [f"SUM({c}) {_frame(n)} AS {c}_cumsum_{n}" for n in windows]


def _names(cells: list[str]) -> str:
    return " ".join(c.rsplit(" AS ", 1)[1] for c in cells)


def _windowed(cells: list[str], source: str = "panel") -> str:
    return rounded_sql(f"SELECT catchment_id, date, {', '.join(cells)} FROM {source}", "catchment_id date", _names(cells), source)


def _out(df, *skip):
    base = {TARGET, PRECIP, TMAX, TMIN, "pet_mm", "pos", "basin", "area_km2", "latitude", "longitude", *skip}
    return rounded(df.select(*[c for c in df.columns if c not in base]))


@query(with_("SELECT catchment_id, date, row_number() OVER (PARTITION BY catchment_id ORDER BY date) AS pos FROM obs", "obs"))
def with_position(spark, folder):
    return order.with_position(X.observed(spark, folder).select(ENTITY, DATE))


@query(_windowed(_lag_sql(TARGET, LAGS)))
def lag_target(spark, folder):
    return _out(series.lag_target(X.panel(spark, folder, TARGET), LAGS, dealt=True))


@query(_windowed(_lag_sql(PRECIP, (1, 3, 7)) + _lag_sql(TMAX, (1, 3, 7)), "obs"))
def lag_covariates(spark, folder):
    return _out(series.lag_covariates(X.observed(spark, folder), [PRECIP, TMAX, "not_there"]))


@query(_windowed(_roll_sql(TARGET, WINDOWS, SQL_STATS) + _roll_sql(PRECIP, WINDOWS, SQL_STATS)))
def rolling_stats(spark, folder):
    return _out(series.rolling_stats(X.panel(spark, folder, TARGET, PRECIP), [TARGET, PRECIP], dealt=True))


@query(_windowed(_roll_sql(TARGET, (7, 30), SQL_STATS, False), "obs"))
def rolling_stats_before_today(spark, folder):
    return _out(series.rolling_stats(X.observed(spark, folder), [TARGET], (7, 30), include_current=False))


@query(_windowed(_sum_sql(PRECIP, WINDOWS)))
def rolling_sum(spark, folder):
    return _out(series.rolling_sum(X.panel(spark, folder, PRECIP), dealt=True))


_DRY = f"CAST(SUM(CASE WHEN {PRECIP} < 0.1 THEN 1 ELSE 0 END) {_frame(7)} AS BIGINT) AS {PRECIP}_dry_days_7"


@query(with_(f"SELECT catchment_id, date, {_DRY} FROM panel", "panel"))
def dry_days(spark, folder):
    return _out(series.dry_days(X.panel(spark, folder, PRECIP), dealt=True))


@query(with_(f"SELECT catchment_id, date, streamflow_mm_day - LAG(streamflow_mm_day) {W} AS diff FROM obs", "obs"))
def diff_1(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET)
    return series.over_series(rows, lambda w: [(F.col(TARGET) - F.lag(TARGET).over(w)).alias("diff")], before=1).drop(TARGET)


_PCT = """CASE WHEN y IS NULL OR b IS NULL THEN NULL WHEN b = 0 AND y > 0 THEN 10.0 WHEN b = 0 AND y < 0 THEN -10.0
  WHEN b = 0 THEN NULL ELSE least(greatest(y / b - 1, -10.0), 10.0) END"""


@query(
    rounded_sql(
        f"SELECT catchment_id, date, {_PCT} AS change FROM (SELECT catchment_id, date, precipitation_mm AS y, LAG(precipitation_mm) {W} AS b FROM obs)",
        "catchment_id date",
        "change",
        "obs",
    )
)
def pct_change_clipped(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, PRECIP)
    changed = series.over_series(
        rows, lambda w: [S.bounded_change(F.col(PRECIP), F.lag(PRECIP).over(w)).alias("change")], before=1
    )
    return rounded(changed.drop(PRECIP))


@query(
    with_(
        f"SELECT catchment_id, date, streamflow_mm_day FROM (SELECT *, row_number() {W} AS rn FROM obs) WHERE rn > 30", "obs"
    )
)
def drop_warmup(spark, folder):
    return series.drop_warmup(X.observed(spark, folder).select(ENTITY, DATE, TARGET), 30)


_UP = "OVER (PARTITION BY catchment_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "OVER (PARTITION BY catchment_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    rounded_sql(
        f"""SELECT catchment_id, date, coalesce(y, pv + (nv - pv) / nullif(np - pp, 0) * (pos - pp), pv, nv) AS streamflow_mm_day FROM (
  SELECT catchment_id, date, pos, streamflow_mm_day AS y,
    last_value(streamflow_mm_day IGNORE NULLS) {_UP} AS pv,
    last_value(CASE WHEN streamflow_mm_day IS NOT NULL THEN CAST(pos AS DOUBLE) END IGNORE NULLS) {_UP} AS pp,
    first_value(streamflow_mm_day IGNORE NULLS) {_DOWN} AS nv,
    first_value(CASE WHEN streamflow_mm_day IS NOT NULL THEN CAST(pos AS DOUBLE) END IGNORE NULLS) {_DOWN} AS np FROM panel)""",
        "catchment_id date",
        "streamflow_mm_day",
        "panel",
    )
)
def interpolate_linear(spark, folder):
    rows = X.panel(spark, folder, TARGET).select(ENTITY, DATE, "pos", TARGET)
    return rounded(series.interpolate_linear(rows, [TARGET], dealt=True).drop("pos"))


@query(
    with_(
        f"""SELECT catchment_id, date, last_value(streamflow_mm_day IGNORE NULLS) {_UP} AS streamflow_mm_day,
  last_value(temperature_max_c IGNORE NULLS) {_UP} AS temperature_max_c FROM panel""",
        "panel",
    )
)
def ffill(spark, folder):
    return series.ffill(X.panel(spark, folder, TARGET, TMAX).select(ENTITY, DATE, TARGET, TMAX), [TARGET, TMAX], dealt=True)


@query(
    with_(
        f"""SELECT catchment_id, MAX(n) AS longest_run FROM (
  SELECT catchment_id, g, CAST(SUM(CAST(below AS INTEGER)) AS BIGINT) AS n FROM (
    SELECT catchment_id, below, SUM(CAST(NOT below AS INTEGER)) {W} AS g FROM (
      SELECT catchment_id, date, coalesce(streamflow_mm_day < 20.0, false) AS below FROM obs)) GROUP BY 1, 2) GROUP BY 1""",
        "obs",
    )
)
def longest_run_below(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET, F.lit(20.0).alias("limit"))
    return series.longest_run_below(rows, TARGET, "limit")


PEAKS_SQL = """SELECT s.catchment_id, date, y_true, y_pred, near_max, threshold, CAST(coalesce(near_max >= threshold, false) AS INTEGER) AS hit
FROM (SELECT *, MAX(y_pred) OVER (PARTITION BY catchment_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near_max FROM scored) s
JOIN (SELECT catchment_id, quantile_cont(y_true, 0.95) AS threshold FROM scored GROUP BY 1) t ON s.catchment_id = t.catchment_id
WHERE y_true >= threshold"""


@query(rounded_sql(PEAKS_SQL, "catchment_id date y_true y_pred near_max hit", "threshold", "scored"))
def peak_hits(spark, folder):
    rows = scored(X.predictions(spark, folder)).select(ENTITY, DATE, OBS, PRED)
    return rounded(series.peak_hits(rows))


def _baseflow_sql(value: str, source: str) -> str:
    """The filter as three recursive queries, one per pass, with the same order of operations."""
    passes = []
    before = "q0"
    for i, (step, start) in enumerate((("+", "1"), ("-", "n"), ("+", "1"))):
        name = f"p{i}"
        passes.append(
            f"""{name}(catchment_id, pos, n, q, qf, bf) AS (
  SELECT catchment_id, pos, n, q, 0.0::DOUBLE, bf FROM {before} WHERE pos = {start}
  UNION ALL
  SELECT x.catchment_id, x.pos, x.n, x.q, x.f, CASE WHEN x.f < x.q THEN least(x.b, x.q - x.f) ELSE x.b END FROM (
    SELECT z.catchment_id, z.pos, z.n, z.q, z.bf AS b,
      greatest(0.925::DOUBLE * r.qf + ((1 + 0.925::DOUBLE) / 2) * (z.bf - r.bf), 0.0) AS f
    FROM {name} r JOIN {before} z ON z.catchment_id = r.catchment_id AND z.pos = r.pos {step} 1) x)"""
        )
        before = name
    first = f"""q0 AS MATERIALIZED (SELECT catchment_id, date, row_number() {W} AS pos, COUNT(*) OVER (PARTITION BY catchment_id) AS n,
  greatest({value}, 0.0) AS q, greatest({value}, 0.0) AS bf FROM {source} WHERE {value} IS NOT NULL)"""
    return first + ",\n" + ",\n".join(passes)


def baseflow_query(value: str, source: str, body: str) -> str:
    head = with_("", source).removeprefix("WITH ")
    return f"WITH RECURSIVE {head},\n{_baseflow_sql(value, source)}\n{body}"


@query(
    baseflow_query(
        "y_true",
        "scored",
        """SELECT q0.catchment_id, q0.date, q0.q AS y_true, round(p2.bf, 6) + 0.0 AS baseflow
FROM p2 JOIN q0 ON p2.catchment_id = q0.catchment_id AND p2.pos = q0.pos""",
    )
)
def baseflow(spark, folder):
    return rounded(B.baseflow(scored(X.predictions(spark, folder)), OBS))


@query(
    baseflow_query(
        "y_pred",
        "scored",
        "SELECT catchment_id, round(CASE WHEN SUM(q) > 0 THEN SUM(bf) / SUM(q) ELSE 0.0 END, 6) + 0.0 AS bfi FROM p2 GROUP BY 1",
    )
)
def baseflow_index(spark, folder):
    return rounded(B.baseflow_index(scored(X.predictions(spark, folder)), PRED))


@query(
    with_(
        f"""SELECT catchment_id, date, y0, y6, CASE WHEN rn > n - greatest(1, CAST(floor((n - 6) * 0.1::DOUBLE) AS BIGINT)) THEN 'validation' ELSE 'train' END AS part
FROM (SELECT catchment_id, date, LAG(streamflow_mm_day, 6) {W} AS y0, streamflow_mm_day AS y6, row_number() {W} AS rn,
  COUNT(*) OVER (PARTITION BY catchment_id) AS n FROM obs) WHERE rn >= 7""",
        "obs",
    )
)
def sequence_windows(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET, PRECIP)
    framed = series.sequence_windows(rows, [TARGET, PRECIP], 7)
    return framed.select(
        ENTITY, DATE, F.col("window")[0][TARGET].alias("y0"), F.col("window")[6][TARGET].alias("y6"), "part"
    )


_TRIALS = f"""SELECT m AS model, trial, round({X.NSE}, 6) + 0.0 AS score FROM (
  SELECT 'persist' AS m, CAST(year(date) * 100 + month(date) AS INTEGER) AS trial, y_true AS o, y_pred AS p FROM scored
  UNION ALL SELECT 'climate', CAST(year(date) * 100 + month(date) AS INTEGER), y_true, clim FROM scored WHERE clim IS NOT NULL) GROUP BY 1, 2"""


def month_trials(spark, folder):
    """One trial per model and month of the test period: its NSE."""
    rows = scored(X.predictions(spark, folder))
    both = F.array(
        F.struct(F.lit("persist").alias("model"), F.col(PRED).alias("p")),
        F.struct(F.lit("climate").alias("model"), F.col("clim").alias("p")),
    )
    long = rows.select(DATE, OBS, F.explode(both).alias("x")).select(DATE, OBS, "x.*")
    trial = (F.year(DATE) * 100 + F.month(DATE)).alias("trial")
    return long.groupBy("model", trial).agg(F.round(Errors(OBS, "p").nse(), 6).alias("score"))


@query(
    with_(
        f"SELECT *, MAX(score) OVER (PARTITION BY model ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM ({_TRIALS})",
        "scored",
    )
)
def running_best(spark, folder):
    return series.running_best(month_trials(spark, folder))


_ENGINEERED = (
    _lag_sql(TARGET, LAGS)
    + _roll_sql(TARGET, WINDOWS, SQL_STATS)
    + [f"LAG({c}, {k}) {W} AS {c}_lag_{k}" for c in (PRECIP, TMAX, TMIN, "pet_mm") for k in (1, 3, 7)]
    + _roll_sql(PRECIP, WINDOWS, SQL_STATS)
    + _sum_sql(PRECIP, WINDOWS)
    + [
        f"streamflow_mm_day - LAG(streamflow_mm_day) {W} AS streamflow_change",
        f"""CASE WHEN streamflow_mm_day IS NULL OR LAG(streamflow_mm_day) {W} IS NULL THEN NULL
  WHEN LAG(streamflow_mm_day) {W} = 0 AND streamflow_mm_day > 0 THEN 10.0 WHEN LAG(streamflow_mm_day) {W} = 0 THEN NULL
  ELSE least(greatest(streamflow_mm_day / LAG(streamflow_mm_day) {W} - 1, -10.0), 10.0) END AS streamflow_pct_change""",
        "sin(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS day_sin",
        "cos(2 * pi() * dayofyear(date) / 365.25::DOUBLE) AS day_cos",
        "sin(2 * pi() * month(date) / 12) AS month_sin",
        "cos(2 * pi() * month(date) / 12) AS month_cos",
        "temperature_max_c - temperature_min_c AS temperature_range_c",
        "(temperature_max_c + temperature_min_c) / 2.0 AS temperature_mean_c",
        "precipitation_mm / (pet_mm + 0.01::DOUBLE) AS precip_pet_ratio",
        "precipitation_mm - pet_mm AS water_balance_mm",
        "CASE WHEN precipitation_mm > 0 THEN precipitation_mm ELSE 0.0 END AS precip_intensity",
    ]
)
_FLAGS = [
    _DRY,
    "CAST(month(date) IN (6,7,8,9) AS INTEGER) AS is_monsoon",
    "CAST(month(date) IN (3,4,5) AS INTEGER) AS is_pre_monsoon",
    "CAST(month(date) IN (10,11) AS INTEGER) AS is_post_monsoon",
    "CAST(month(date) IN (12,1,2) AS INTEGER) AS is_winter",
    "CASE WHEN precipitation_mm > 1.0 THEN 1 ELSE 0 END AS is_rainy_day",
]


@query(
    rounded_sql(
        f"SELECT * FROM (SELECT catchment_id, date, streamflow_mm_day, row_number() {W} AS rn, {', '.join(_ENGINEERED + _FLAGS)} FROM obs) WHERE rn > 30",
        f"catchment_id date streamflow_mm_day {_names(_FLAGS)}",
        _names(_ENGINEERED),
        "obs",
    )
)
def engineer_features(spark, folder):
    return rounded(FE.engineer_features(X.dealt(spark, X.observed(spark, folder)), dealt=True).drop(PRECIP, TMAX, TMIN, "pet_mm"))
