"""Fitted transforms, folds, resampling and prediction intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from daypanel.operators import fitted, intervals, order, resample, series
from daypanel.operators import panel as P
from daypanel.queries import shared as X
from daypanel.queries.panels import _RANKED, _plain
from daypanel.queries.registry import fragment, query, rounded, rounded_sql, with_
from daypanel.schema import DATE, ENTITY, OBS, PRECIP, PRED, TARGET, TMAX
from daypanel.session import durable

VALUES = (TARGET, PRECIP, TMAX)
_EXTREME_ROWS = """SELECT COUNT(*) FROM train WHERE streamflow_mm_day >= (SELECT quantile_cont(streamflow_mm_day, 0.95) FROM train)
  OR streamflow_mm_day <= (SELECT quantile_cont(streamflow_mm_day, 0.05) FROM train)"""
fragment("train", f"SELECT * FROM obs WHERE date <= DATE '{X.TRAIN_END}'", "obs")


def _split(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, *VALUES)
    return P.temporal_split(rows, X.TRAIN_END, X.TEST_START)


def _scaled_sql(center: str, scale: str) -> str:
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in VALUES)
    cells = ", ".join(f"({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in VALUES)
    return rounded_sql(
        f"SELECT catchment_id, date, {cells} FROM obs JOIN (SELECT {stats} FROM train) ON true WHERE date >= DATE '{X.TEST_START}'",
        "catchment_id date",
        " ".join(VALUES),
        "obs",
        "train",
    )


@query(_scaled_sql("AVG({c})", "STDDEV_POP({c})"))
def standard_scale(spark, folder):
    train, test = _split(spark, folder)
    return rounded(fitted.scale_columns(test, fitted.fit_standard(train, VALUES).collect()))


@query(_scaled_sql("MIN({c})", "(MAX({c}) - MIN({c}))"))
def minmax_scale(spark, folder):
    train, test = _split(spark, folder)
    return rounded(fitted.scale_columns(test, fitted.fit_minmax(train, VALUES).collect()))


_CARRY = "last_value({c} IGNORE NULLS) OVER (PARTITION BY catchment_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    rounded_sql(
        f"""SELECT f.catchment_id, f.date, coalesce(f.precipitation_mm, m_p) AS precipitation_mm, coalesce(f.temperature_max_c, m_t) AS temperature_max_c FROM (
  SELECT catchment_id, date, {_CARRY.format(c=PRECIP)} AS precipitation_mm, {_CARRY.format(c=TMAX)} AS temperature_max_c FROM panel WHERE date >= DATE '{X.TEST_START}') f
JOIN (SELECT median(p) AS m_p, median(t) AS m_t FROM (SELECT {_CARRY.format(c=PRECIP)} AS p, {_CARRY.format(c=TMAX)} AS t FROM panel WHERE date <= DATE '{X.TRAIN_END}')) ON true""",
        "catchment_id date",
        "precipitation_mm temperature_max_c",
        "panel",
    )
)
def impute_median(spark, folder):
    rows = X.panel(spark, folder, PRECIP, TMAX).select(ENTITY, DATE, PRECIP, TMAX)
    train, test = P.temporal_split(rows, X.TRAIN_END, X.TEST_START)
    names = [PRECIP, TMAX]
    medians = {r["column"]: r["median"] for r in fitted.column_medians(series.ffill(train, names, dealt=True), names).collect()}
    return rounded(fitted.fill_medians(series.ffill(test, names, dealt=True), medians))


@query(
    rounded_sql(
        f"""SELECT catchment_id, date, streamflow_mm_day, (coalesce(x, m) - c) / s AS precipitation_mm FROM (
  SELECT catchment_id, date, streamflow_mm_day, {_CARRY.format(c="x")} AS x FROM (SELECT *, CASE WHEN precipitation_mm > 0 OR pet_mm > 2 THEN precipitation_mm END AS x FROM obs) WHERE date >= DATE '{X.TEST_START}') t
JOIN (SELECT m, AVG(coalesce(x, m)) AS c, STDDEV_POP(coalesce(x, m)) AS s FROM (
  SELECT x, median(x) OVER () AS m FROM (SELECT {_CARRY.format(c="x")} AS x FROM (SELECT *, CASE WHEN precipitation_mm > 0 OR pet_mm > 2 THEN precipitation_mm END AS x FROM obs) WHERE date <= DATE '{X.TRAIN_END}')) GROUP BY 1) ON true""",
        "catchment_id date streamflow_mm_day",
        "precipitation_mm",
        "obs",
    )
)
def preprocess(spark, folder):
    gappy = X.observed(spark, folder).select(
        ENTITY,
        DATE,
        TARGET,
        F.when((F.col(PRECIP) > 0) | (F.col("pet_mm") > 2), F.col(PRECIP)).alias(PRECIP),
        F.when(F.col("pet_mm") > 6, F.col("pet_mm")).alias("mostly_missing"),
    )
    return rounded(fitted.preprocess(gappy, X.TRAIN_END, X.TEST_START).test)


_GAPPY = "SELECT *, CASE WHEN precipitation_mm > 0 OR pet_mm > 2 THEN precipitation_mm END AS x FROM obs"
_BY_RANK = f"SELECT *, row_number() OVER (ORDER BY date, md5(CAST(catchment_id AS VARCHAR)), catchment_id) - 1 AS r, COUNT(*) OVER () AS n FROM ({_GAPPY})"


def _gappy(spark, folder):
    return X.observed(spark, folder).select(
        ENTITY, DATE, TARGET, F.when((F.col(PRECIP) > 0) | (F.col("pet_mm") > 2), F.col(PRECIP)).alias(PRECIP)
    )


@query(
    rounded_sql(
        f"""SELECT catchment_id, date, streamflow_mm_day, (coalesce(f, m) - c) / s AS precipitation_mm FROM (
  SELECT catchment_id, date, streamflow_mm_day, {_CARRY.format(c="x")} AS f FROM ({_BY_RANK}) WHERE r >= floor(n * 0.8::DOUBLE)) t
JOIN (SELECT m, AVG(coalesce(f, m)) AS c, STDDEV_POP(coalesce(f, m)) AS s FROM (
  SELECT f, median(f) OVER () AS m FROM (SELECT {_CARRY.format(c="x")} AS f FROM ({_BY_RANK}) WHERE r < floor(n * 0.8::DOUBLE))) GROUP BY 1) ON true""",
        "catchment_id date streamflow_mm_day",
        "precipitation_mm",
        "obs",
    )
)
def preprocess_by_fraction(spark, folder):
    return rounded(fitted.preprocess(_gappy(spark, folder)).test)


@query(
    with_(
        f"""SELECT is_synthetic, n FROM (SELECT false AS is_synthetic, COUNT(*) AS n FROM train
UNION ALL SELECT true, CAST(floor(({_EXTREME_ROWS}) * 0.5) AS BIGINT))""",
        "train",
    )
)
def preprocess_oversampled(spark, folder):
    train = fitted.preprocess(_gappy(spark, folder), X.TRAIN_END, X.TEST_START, oversample_share=0.5).train
    return train.groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n"))


# --- folds and resampling ----------------------------------------------------------------------


@query(
    with_(
        f"""SELECT catchment_id, date, streamflow_mm_day, rank0,
  CAST(CASE WHEN rank0 - (n_rows - 4 * (n_rows // 5)) >= 0 THEN (rank0 - (n_rows - 4 * (n_rows // 5))) // (n_rows // 5) END AS INTEGER) AS fold FROM ({_RANKED})""",
        "obs",
    )
)
def time_series_folds(spark, folder):
    return order.time_series_folds(_plain(spark, folder), 4)


@query(
    with_(
        f"""SELECT fold, COUNT(*) AS n, MIN(date) AS first_day, MAX(date) AS last_day FROM (SELECT date,
  CAST(CASE WHEN c - (n_rows - 4 * (n_rows // 5)) >= 0 THEN (c - (n_rows - 4 * (n_rows // 5))) // (n_rows // 5) END AS INTEGER) AS fold
  FROM (SELECT date, n_rows, MIN(rank0) OVER (PARTITION BY date) AS c FROM ({_RANKED}))) GROUP BY 1""",
        "obs",
    )
)
def time_series_folds_whole_days(spark, folder):
    folds = order.time_series_folds(_plain(spark, folder), 4, whole_days=True)
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day")
    )


_EXTREME = """SELECT COUNT(*) FROM train WHERE streamflow_mm_day >= (SELECT quantile_cont(streamflow_mm_day, 0.95) FROM train)
  OR streamflow_mm_day <= (SELECT quantile_cont(streamflow_mm_day, 0.05) FROM train)"""


@query(
    with_(
        f"SELECT false AS is_synthetic, COUNT(*) AS n FROM train UNION ALL SELECT true, CAST(floor(({_EXTREME}) * 0.5) AS BIGINT)",
        "train",
    )
)
def oversample_extremes(spark, folder):
    train, _ = _split(spark, folder)
    grown = resample.oversample_extremes(train, [PRECIP, TMAX])
    return grown.groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query()
def append_synthetic(spark, folder):
    train, _ = _split(spark, folder)
    return resample.oversample_extremes(train, [PRECIP, TMAX], share=0.25)


@query(with_("SELECT * FROM (SELECT catchment_id, date, streamflow_mm_day FROM obs) ORDER BY md5('42|' || catchment_id || '|' || date), catchment_id, date LIMIT 500", "obs"))
def sample_rows(spark, folder):
    return order.sample_rows(_plain(spark, folder), 500)


# --- intervals ---------------------------------------------------------------------------------

fragment(
    "lagged",
    "SELECT catchment_id, date, streamflow_mm_day AS y_true, LAG(streamflow_mm_day) OVER (PARTITION BY catchment_id ORDER BY date) AS y_pred FROM obs",
    "obs",
)
fragment(
    "parted",
    f"""
SELECT *, CASE WHEN n > 50 AND r >= n - greatest(20, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'calibration' ELSE 'fit' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY date, md5(CAST(catchment_id AS VARCHAR)), catchment_id) - 1 AS r, COUNT(*) OVER () AS n
  FROM lagged WHERE date <= DATE '{X.TRAIN_END}')""",
    "lagged",
)
fragment("cuts", "SELECT quantile_cont(y_pred, [0.25, 0.5, 0.75]) AS c FROM parted WHERE part = 'fit'", "parted")
_SEASON = "CASE WHEN month(date) IN (6,7,8,9) THEN 'monsoon' WHEN month(date) IN (3,4,5) THEN 'pre_monsoon' WHEN month(date) IN (10,11) THEN 'post_monsoon' ELSE 'winter' END AS season"
_BUCKET = "CAST(CASE WHEN y_pred IS NULL THEN -1 WHEN y_pred < c[1] THEN 0 WHEN y_pred < c[2] THEN 1 WHEN y_pred < c[3] THEN 2 ELSE 3 END AS INTEGER) AS lag_bucket"
fragment(
    "fitted",
    f"""
SELECT season, lag_bucket, quantile_cont(y_true, 0.05) AS lo, quantile_cont(y_true, 0.5) AS med, quantile_cont(y_true, 0.95) AS hi
FROM (SELECT y_true, {_SEASON}, {_BUCKET} FROM parted JOIN cuts ON true WHERE part = 'fit') GROUP BY 1, 2""",
    "parted",
    "cuts",
)
fragment(
    "banded",
    f"""
SELECT t.catchment_id, t.date, t.y_true, t.season, t.lag_bucket, lo, med, hi FROM (
  SELECT catchment_id, date, y_true, {_SEASON}, {_BUCKET} FROM lagged JOIN cuts ON true WHERE date >= DATE '{X.TEST_START}') t
LEFT JOIN fitted f ON f.season = t.season AND f.lag_bucket = t.lag_bucket""",
    "lagged",
    "cuts",
    "fitted",
)
fragment(
    "widening",
    f"""
SELECT n, k, list_sort(s)[k] AS q FROM (SELECT list(score) AS s, COUNT(*) AS n, least(greatest(CAST(ceil((COUNT(*) + 1) * (0.95::DOUBLE - 0.05::DOUBLE)) AS BIGINT), 1), COUNT(*)) AS k FROM (
  SELECT greatest(lo - y_true, y_true - hi) AS score FROM (SELECT y_true, {_SEASON}, {_BUCKET} FROM parted JOIN cuts ON true WHERE part = 'calibration') x
  JOIN fitted f ON f.season = x.season AND f.lag_bucket = x.lag_bucket))""",
    "parted",
    "cuts",
    "fitted",
)
fragment(
    "intervals",
    """
SELECT catchment_id, date, y_true, greatest(b[1], 0.0) AS lo, greatest(b[2], 0.0) AS med, greatest(b[3], 0.0) AS hi FROM (
  SELECT catchment_id, date, y_true, CASE WHEN lo IS NOT NULL THEN list_sort([lo - q, med, hi + q]) END AS b FROM banded JOIN widening ON true)""",
    "banded",
    "widening",
)
GROUPS = ["season", "lag_bucket"]


def _interval_parts(spark, folder):
    seen = X.observed(spark, folder).select(ENTITY, DATE, F.col(TARGET).alias(OBS))
    lagged = series.over_series(X.dealt(spark, seen), lambda w: [F.lag(OBS, 1).over(w).alias(PRED)], before=1, dealt=True)
    lagged = durable(lagged, "lagged")  # ranks read it three times
    train, test = P.temporal_split(lagged, X.TRAIN_END, X.TEST_START)
    parted = intervals.calibration_split(train).unionByName(test.withColumn("part", F.lit("test")))
    parted = durable(parted, "parted")
    fit, calibration, test = (parted.where(F.col("part") == name) for name in ("fit", "calibration", "test"))
    cuts = intervals.lag_cut_row(fit, PRED)
    learned = intervals.fit_group_quantiles(intervals.condition_columns(fit, PRED, cuts), GROUPS)

    def band(rows):
        return intervals.quantile_predict(intervals.condition_columns(rows, PRED, cuts), learned, GROUPS)

    return band(calibration), band(test)


def _intervals(spark, folder):
    calibration, test = _interval_parts(spark, folder)
    return intervals.predict_interval(test, intervals.conformal_calibrate(calibration))


@query(rounded_sql("SELECT * FROM banded", "catchment_id date y_true season lag_bucket", "lo med hi", "banded"))
def quantile_predict(spark, folder):
    _, test = _interval_parts(spark, folder)
    return rounded(test.drop(PRED, "part"))


@query(rounded_sql("SELECT * FROM widening", "n k", "q", "widening"))
def conformal_calibrate(spark, folder):
    calibration, _ = _interval_parts(spark, folder)
    return rounded(intervals.conformal_calibrate(calibration))


@query(rounded_sql("SELECT * FROM intervals", "catchment_id date y_true", "lo med hi", "intervals"))
def predict_interval(spark, folder):
    return rounded(_intervals(spark, folder).select(ENTITY, DATE, OBS, "lo", "med", "hi"))


@query(
    with_(
        """SELECT round(0.95::DOUBLE - 0.05::DOUBLE, 3) AS nominal_coverage, round(AVG(CASE WHEN y_true BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS picp_observed_coverage,
  round(AVG(hi - lo), 4) + 0.0 AS mpiw_mean_interval_width, round(AVG(CASE WHEN y_true BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) - (0.95::DOUBLE - 0.05::DOUBLE), 4) + 0.0 AS coverage_error
FROM intervals WHERE lo IS NOT NULL""",
        "intervals",
    )
)
def interval_quality(spark, folder):
    return intervals.interval_quality(_intervals(spark, folder))


@query(
    rounded_sql("SELECT date, catchment_id, y_true, lo, med, hi FROM intervals ORDER BY date, catchment_id LIMIT 400", "date catchment_id y_true", "lo med hi", "intervals")
)
def interval_series(spark, folder):
    return rounded(intervals.interval_series(_intervals(spark, folder)))
