"""Benchmark, risk and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from daypanel.operators import compare, profiles, risk
from daypanel.operators.panel import attach_risk_attrs as attach_attrs
from daypanel.operators.scores import metric_suite, scored
from daypanel.queries import shared as X
from daypanel.queries.registry import fragment, query, rounded, rounded_sql, with_
from daypanel.queries.sequences import _TRIALS, month_trials
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PRECIP, PRED, TARGET, TMAX

# --- benchmark ---------------------------------------------------------------------------------


fragment(
    "paired",
    """
SELECT catchment_id, y_true, y_pred, clim FROM preds
WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-06-30' AND y_true IS NOT NULL AND y_pred IS NOT NULL AND clim IS NOT NULL""",
    "preds",
)
fragment(
    "bench",
    f"""
SELECT * FROM (SELECT catchment_id, COUNT(*) AS n_obs, {X.NSE} AS model_nse, {X.KGE} AS model_kge FROM (SELECT catchment_id, y_true AS o, y_pred AS p FROM paired) GROUP BY 1)
JOIN (SELECT catchment_id, {X.NSE} AS baseline_nse, {X.KGE} AS baseline_kge FROM (SELECT catchment_id, y_true AS o, clim AS p FROM paired) GROUP BY 1) USING (catchment_id)
WHERE n_obs >= 30""",
    "paired",
)


def _bench(spark, folder):
    p = X.predictions(spark, folder)
    ours = p.select(ENTITY, DATE, OBS, PRED)
    return compare.benchmark_per_entity(ours, p.select(ENTITY, DATE, "clim"), "clim", "1999-01-01", "2001-06-30")


@query(rounded_sql("SELECT * FROM bench", "catchment_id n_obs", "model_nse model_kge baseline_nse baseline_kge", "bench"))
def benchmark_per_entity(spark, folder):
    return rounded(_bench(spark, folder))


_BENCH_STATS = ", ".join(
    f"round({f}({c}), 4) + 0.0 AS {name}_{c}"
    for c in ("model_nse", "model_kge", "baseline_nse", "baseline_kge")
    for name, f in (("median", "median"), ("mean", "AVG"))
)


@query(
    with_(
        f"SELECT COUNT(*) AS n_catchments, round(SUM(CASE WHEN model_nse > baseline_nse THEN 1 ELSE 0 END) / COUNT(*), 3) + 0.0 AS win_rate_nse, {_BENCH_STATS} FROM bench",
        "bench",
    )
)
def benchmark_summary(spark, folder):
    return compare.benchmark_summary(_bench(spark, folder))


@query(
    rounded_sql(
        """SELECT side, MIN(nse) AS min, quantile_cont(nse, 0.25) AS q1, median(nse) AS median, quantile_cont(nse, 0.75) AS q3, MAX(nse) AS max, AVG(nse) AS mean FROM (
  SELECT 'model' AS side, greatest(model_nse, -1.0) AS nse FROM bench UNION ALL SELECT 'baseline', greatest(baseline_nse, -1.0) FROM bench) GROUP BY 1""",
        "side",
        "min q1 median q3 max mean",
        "bench",
    )
)
def nse_distribution(spark, folder):
    return rounded(compare.nse_distribution(_bench(spark, folder)))


fragment(
    "loo",
    f"""
SELECT catchment_id AS held_out, {X.SUITE}, COUNT(*) AS n_test, any_value(basin) AS basin FROM (
  SELECT x.catchment_id, basin, x.streamflow_mm_day AS o, greatest((sa - s) / (na - n), 0.0) AS p
  FROM obs x JOIN attrs USING (catchment_id) JOIN (SELECT catchment_id, COUNT(*) AS n, SUM(streamflow_mm_day) AS s FROM obs GROUP BY 1) e ON e.catchment_id = x.catchment_id
  JOIN (SELECT COUNT(*) AS na, SUM(streamflow_mm_day) AS sa FROM obs) ON true WHERE n >= 30 AND na - n >= 100) GROUP BY 1""",
    "obs",
    "attrs",
)


def _loo(spark, folder):
    from daypanel.modelling.validation import leave_one_out_mean

    rows = X.observed(spark, folder).select(ENTITY, DATE, TARGET)
    return leave_one_out_mean(rows.join(X.attributes(spark, folder).select(ENTITY, BASIN), ENTITY))


@query(
    with_(
        """SELECT COUNT(*) AS n_catchments, round(median(nse), 4) + 0.0 AS median_nse, round(AVG(nse), 4) + 0.0 AS mean_nse,
  round(AVG(CASE WHEN nse > 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS frac_nse_above_0, round(AVG(CASE WHEN nse > 0.5 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS frac_nse_above_0_5,
  round(median(kge), 4) + 0.0 AS median_kge FROM loo""",
        "loo",
    )
)
def spatial_summary(spark, folder):
    return compare.spatial_summary(_loo(spark, folder))


@query(with_("SELECT basin, round(median(nse), 4) + 0.0 AS median_nse FROM loo GROUP BY 1", "loo"))
def spatial_summary_by_basin(spark, folder):
    return compare.spatial_summary_by_group(_loo(spark, folder))


# --- risk --------------------------------------------------------------------------------------

fragment("flows", "SELECT catchment_id, date, greatest(y_pred, 0.0) AS x FROM preds WHERE y_pred IS NOT NULL", "preds")
fragment(
    "limits",
    "SELECT catchment_id, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM flows GROUP BY 1",
    "flows",
)
fragment(
    "runs",
    """
SELECT catchment_id, MAX(n) AS longest_run FROM (SELECT catchment_id, g, CAST(SUM(CAST(below AS INTEGER)) AS BIGINT) AS n FROM (
  SELECT catchment_id, below, SUM(CAST(NOT below AS INTEGER)) OVER (PARTITION BY catchment_id ORDER BY date) AS g
  FROM (SELECT f.catchment_id, date, x < p10 AS below FROM flows f JOIN limits USING (catchment_id))) GROUP BY 1, 2) GROUP BY 1""",
    "flows",
    "limits",
)
fragment(
    "raw_risk",
    """
SELECT s.*, longest_run, least(greatest(0.3 * low + 0.3 * often + 0.4 * least(longest_run / 90, 1.0), 0.0), 1.0) AS drought FROM (
  SELECT f.catchment_id, COUNT(*) AS n_rows, AVG(x) AS mean_flow, MAX(x) AS max_flow, STDDEV_POP(x) AS std_flow,
    least(greatest(0.4 * least(AVG(CASE WHEN x > p95 THEN 1.0 ELSE 0.0 END) * 20, 1.0) + 0.4 * least(MAX(p99) / (AVG(x) + 0.01::DOUBLE) / 10, 1.0)
      + 0.2 * least(STDDEV_POP(x) / (AVG(x) + 0.01::DOUBLE) / 3, 1.0), 0.0), 1.0) AS flood,
    1 - least(MAX(p5) / (AVG(x) + 0.01::DOUBLE), 1.0) AS low, least(AVG(CASE WHEN x < p10 THEN 1.0 ELSE 0.0 END) * 10, 1.0) AS often
  FROM flows f JOIN limits USING (catchment_id) GROUP BY 1) s JOIN runs USING (catchment_id)""",
    "flows",
    "limits",
    "runs",
)


def _level(score: str, cuts=(0.2, 0.4, 0.6, 0.8)) -> str:
    names = ("Very Low", "Low", "Moderate", "High")
    return "CASE " + " ".join(f"WHEN {score} < {c} THEN '{n}'" for c, n in zip(cuts, names, strict=True)) + " ELSE 'Very High' END"


fragment(
    "risk",
    f"""
SELECT r.catchment_id, round(flood, 4) + 0.0 AS flood_risk_score, round(drought, 4) + 0.0 AS drought_risk_score,
  round(0.5 * flood + 0.5 * drought, 4) + 0.0 AS combined_risk_score, {_level("flood")} AS flood_risk_level, {_level("drought")} AS drought_risk_level,
  {_level("(0.5 * flood + 0.5 * drought)")} AS combined_risk_level, round(mean_flow, 3) + 0.0 AS mean_predicted_flow, round(max_flow, 3) + 0.0 AS max_predicted_flow,
  round(std_flow / (mean_flow + 0.01::DOUBLE), 4) + 0.0 AS cv_predicted_flow, latitude, longitude, area_km2, basin
FROM raw_risk r LEFT JOIN attrs a ON a.catchment_id = r.catchment_id WHERE n_rows >= 30""",
    "raw_risk",
    "attrs",
)


def _flows(spark, folder):
    return X.predictions(spark, folder).select(ENTITY, DATE, PRED)


def _risk(spark, folder):
    return risk.risk_scores(_flows(spark, folder), X.attributes(spark, folder))


@query(rounded_sql("SELECT catchment_id, flood AS flood_score FROM raw_risk", "catchment_id", "flood_score", "raw_risk"))
def flood_score(spark, folder):
    return rounded(risk.flood_score(_flows(spark, folder)))


@query(rounded_sql("SELECT catchment_id, drought AS drought_score, longest_run FROM raw_risk", "catchment_id longest_run", "drought_score", "raw_risk"))
def drought_score(spark, folder):
    return rounded(risk.drought_score(_flows(spark, folder)))


@query(
    with_(
        f"""SELECT catchment_id, date, score, {_level("score")} AS level, {_level("score", (0.1, 0.3, 0.5, 0.7))} AS strict_level
FROM (SELECT catchment_id, date, streamflow_mm_day / 50.0 AS score FROM obs)""",
        "obs",
    )
)
def risk_level(spark, folder):
    rows = X.observed(spark, folder).select(ENTITY, DATE, (F.col(TARGET) / 50.0).alias("score"))
    return rows.select(
        "*",
        risk.risk_level(F.col("score")).alias("level"),
        risk.risk_level(F.col("score"), (0.1, 0.3, 0.5, 0.7)).alias("strict_level"),
    )


@query(with_("SELECT * FROM risk", "risk"))
def risk_scores(spark, folder):
    return _risk(spark, folder)


@query(
    with_(
        """SELECT risk_type, level, COUNT(*) AS n_catchments, (SELECT COUNT(*) FROM risk) AS total_catchments FROM (
  SELECT 'flood' AS risk_type, flood_risk_level AS level FROM risk UNION ALL SELECT 'drought', drought_risk_level FROM risk) GROUP BY 1, 2""",
        "risk",
    )
)
def risk_distribution(spark, folder):
    return risk.risk_distribution(_risk(spark, folder))


@query(
    with_(
        "SELECT basin, COUNT(*) AS n_catchments, round(AVG(flood_risk_score), 4) + 0.0 AS mean_flood_risk, round(AVG(drought_risk_score), 4) + 0.0 AS mean_drought_risk FROM risk GROUP BY 1",
        "risk",
    )
)
def risk_by_basin(spark, folder):
    return risk.risk_by_basin(_risk(spark, folder))


@query(with_("SELECT catchment_id, flood_risk_score, flood_risk_level FROM risk ORDER BY flood_risk_score DESC, catchment_id", "risk"))
def rank_risk(spark, folder):
    return risk.rank_risk(_risk(spark, folder), "flood")


@query(
    with_(
        "SELECT e.catchment_id, n_days, latitude, longitude, area_km2, basin FROM (SELECT catchment_id, COUNT(*) AS n_days FROM activity GROUP BY 1) e LEFT JOIN attrs a ON a.catchment_id = e.catchment_id",
        "activity",
        "attrs",
    )
)
def attach_risk_attrs(spark, folder):
    days = X.activity(spark, folder).groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n_days"))
    return attach_attrs(days, X.attributes(spark, folder))


# --- model tables ------------------------------------------------------------------------------


@query(
    with_(
        f"""SELECT 'persist' AS model, {X.SUITE} FROM (SELECT y_true AS o, y_pred AS p FROM scored)
UNION ALL SELECT 'climate', {X.SUITE} FROM (SELECT y_true AS o, clim AS p FROM scored WHERE clim IS NOT NULL)""",
        "scored",
    )
)
def rank_models(spark, folder):
    rows = scored(X.predictions(spark, folder))
    sides = F.array(
        F.struct(F.lit("persist").alias("model"), F.col(PRED).alias("p")),
        F.struct(F.lit("climate").alias("model"), F.col("clim").alias("p")),
    )
    long = rows.select(F.col(OBS), F.explode(sides).alias("x")).select(OBS, "x.model", F.col("x.p").alias(PRED))
    return compare.rank_models(metric_suite(long, ["model"]))


@query(
    with_(
        f"""SELECT model, trial, score, place FROM (SELECT *, CAST(CASE model WHEN 'persist' THEN 0 ELSE 1 END * 1000000 + trial AS INTEGER) AS place FROM ({_TRIALS}))
WHERE score IS NOT NULL ORDER BY score DESC, place LIMIT 1""",
        "scored",
    )
)
def pick_best_model(spark, folder):
    place = F.when(F.col("model") == "persist", 0).otherwise(1) * 1000000 + F.col("trial")
    return compare.pick_best_model(month_trials(spark, folder).withColumn("place", place))


@query(
    rounded_sql(
        """SELECT feature, AVG(abs(v)) AS mean_abs FROM (
  SELECT 'residual' AS feature, y_true - y_pred AS v FROM scored UNION ALL SELECT 'rain', precipitation_mm FROM scored UNION ALL SELECT 'flow', y_true FROM scored)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2""",
        "feature",
        "mean_abs",
        "scored",
    )
)
def top_features(spark, folder):
    rows = scored(X.predictions(spark, folder))
    cells = F.array(
        F.struct(F.lit("residual").alias("feature"), (F.col(OBS) - F.col(PRED)).alias("attribution")),
        F.struct(F.lit("rain").alias("feature"), F.col(PRECIP).alias("attribution")),
        F.struct(F.lit("flow").alias("feature"), F.col(OBS).alias("attribution")),
    )
    return rounded(compare.top_features(rows.select(F.explode(cells).alias("x")).select("x.*"), 2))


# --- profiles ----------------------------------------------------------------------------------

_PROFILED = (TARGET, PRECIP, TMAX, "area_km2")


@query(
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing, (COUNT(*) - COUNT({c})) / COUNT(*) * 100 AS missing_pct FROM panel"
            for c in _PROFILED
        ),
        '"column" missing',
        "missing_pct",
        "panel",
    )
)
def missing_profile(spark, folder):
    return rounded(profiles.missing_profile(X.panel(spark, folder), _PROFILED))


@query(
    rounded_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", COUNT(*) AS n_rows, MIN(date) AS first_day, MAX(date) AS last_day, COUNT({c}) AS count, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std,
  MIN({c}) AS min, MAX({c}) AS max, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM panel"""
            for c in _PROFILED
        ),
        '"column" n_rows first_day last_day count',
        "mean std min max q1 median q3",
        "panel",
        digits=4,
    )
)
def describe_panel(spark, folder):
    return rounded(profiles.describe_panel(X.panel(spark, folder), _PROFILED), 4)


@query(
    rounded_sql(
        "SELECT CAST(month(date) AS INTEGER) AS month, AVG(streamflow_mm_day) AS mean_streamflow_mm_day, AVG(precipitation_mm) AS mean_precipitation_mm FROM panel GROUP BY 1",
        "month",
        "mean_streamflow_mm_day mean_precipitation_mm",
        "panel",
    )
)
def monthly_climatology(spark, folder):
    return rounded(profiles.monthly_climatology(X.panel(spark, folder)))


_CORRELATED = (TARGET, PRECIP, TMAX, "pet_mm", "area_km2", "latitude")


@query(
    rounded_sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS correlation FROM panel"
            for a in _CORRELATED
            for b in _CORRELATED
        ),
        "column_a column_b",
        "correlation",
        "panel",
    )
)
def correlation_matrix(spark, folder):
    return rounded(profiles.correlation_matrix(X.panel(spark, folder), _CORRELATED))


@query(
    rounded_sql(
        """SELECT bin, lo + bin * ((hi - lo) / 50) AS left_edge, lo + (bin + 1) * ((hi - lo) / 50) AS right_edge, n FROM (
  SELECT CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, lo, hi, COUNT(*) AS n
  FROM (SELECT streamflow_mm_day AS x FROM obs) JOIN (SELECT MIN(streamflow_mm_day) AS lo, MAX(streamflow_mm_day) AS hi FROM obs) ON true GROUP BY 1, 2, 3)""",
        "bin n",
        "left_edge right_edge",
        "obs",
    )
)
def histogram(spark, folder):
    return rounded(profiles.histogram(X.observed(spark, folder), TARGET))
