"""Error metrics, signatures and interval quality on the test predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from daypanel.operators import scores
from daypanel.queries import shared as X
from daypanel.queries.registry import fragment, query, rounded, rounded_sql, with_
from daypanel.queries.sequences import PEAKS_SQL, baseflow_query
from daypanel.schema import BASIN, DATE, ENTITY, OBS, PRECIP, PRED, REGIMES

fragment("op", "SELECT catchment_id, date, y_true AS o, y_pred AS p, precipitation_mm FROM scored", "scored")


def _rows(spark, folder):
    return X.predictions(spark, folder).select(ENTITY, DATE, OBS, PRED)


def _single(name: str, expression: str) -> None:
    sql = rounded_sql(f"SELECT catchment_id, {expression} AS {name} FROM op GROUP BY 1", "catchment_id", name, "op")

    @query(sql, name=name)
    def run(spark, folder):
        return rounded(scores.single_metric(_rows(spark, folder), name, [ENTITY]))


for _name, _expression in (("nse", X.NSE), ("kge", X.KGE), ("rmse", X.RMSE), ("pbias", X.PBIAS), ("r2", X.NSE)):
    _single(_name, _expression)


@query(with_(f"SELECT basin, {X.SUITE} FROM op JOIN attrs USING (catchment_id) GROUP BY 1", "op", "attrs"))
def metric_suite(spark, folder):
    located = _rows(spark, folder).join(X.attributes(spark, folder).select(ENTITY, BASIN), ENTITY)
    return scores.metric_suite(located, [BASIN])


@query(with_(f"SELECT COUNT(*) AS n, {X.SUITE} FROM op", "op"))
def metric_suite_pooled(spark, folder):
    return scores.metric_suite(_rows(spark, folder), count="n")


def _scope_sql(keys: str, join: str) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    flagged = f"(SELECT op.*, hi, lo FROM op JOIN (SELECT {lead}quantile_cont(o, 0.95) AS hi, quantile_cont(o, 0.05) AS lo FROM op {group}) t {join})"
    parts = [
        f"SELECT {lead}'{scope}' AS scope, {X.SUITE}, COUNT(*) AS n_events FROM {flagged} WHERE {cond} {group}"
        + ("" if scope == "overall" else " HAVING COUNT(*) > 5")
        for scope, cond in (("overall", "true"), ("flood_events", "o >= hi"), ("drought_events", "o <= lo"))
    ]
    return "\nUNION ALL\n".join(parts)


@query(with_(_scope_sql("", "ON true"), "op"))
def extreme_metrics(spark, folder):
    return scores.extreme_metrics(_rows(spark, folder))


@query(with_(_scope_sql("catchment_id", "USING (catchment_id)"), "op"))
def extreme_metrics_per_entity(spark, folder):
    return scores.extreme_metrics(_rows(spark, folder), by=[ENTITY])


_CUTS = "SELECT quantile_cont(o, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS c FROM op"
_REGIME_CASE = " ".join(f"WHEN o >= c[{i + 1}] AND o < c[{i + 2}] THEN '{name}'" for i, name in enumerate(REGIMES))


@query(
    with_(
        f"""SELECT regime, {X.SUITE}, COUNT(*) AS n_samples FROM (SELECT o, p, CASE {_REGIME_CASE} END AS regime FROM op JOIN ({_CUTS}) ON true)
WHERE regime IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 5""",
        "op",
    )
)
def flow_regime_metrics(spark, folder):
    return scores.flow_regime_metrics(_rows(spark, folder))


@query(with_(f"SELECT catchment_id, {X.SUITE}, COUNT(*) AS n_samples FROM op GROUP BY 1 HAVING COUNT(*) >= 10", "op"))
def metrics_per_entity(spark, folder):
    return scores.metrics_per_entity(_rows(spark, folder))


@query(
    with_(
        f"SELECT CAST(month(date) AS INTEGER) AS month, round({X.NSE}, 4) + 0.0 AS nse, COUNT(*) AS n_samples FROM op GROUP BY 1 HAVING COUNT(*) > 10",
        "op",
    )
)
def metrics_per_month(spark, folder):
    return scores.metrics_per_month(_rows(spark, folder))


# --- signatures, per entity and pooled ---------------------------------------------------------

_EPS = "(SELECT op.*, 0.01::DOUBLE * AVG(o) OVER (PARTITION BY catchment_id) AS eps FROM op)"
_LOG_NSE = f"SELECT catchment_id, round({X.NSE}, 4) + 0.0 AS log_nse FROM (SELECT catchment_id, ln(o + eps) AS o, ln(p + eps) AS p FROM {_EPS}) GROUP BY 1"
_FHV = """SELECT op.catchment_id, round(CASE WHEN SUM(o) = 0 THEN 0.0 ELSE 100.0 * SUM(p - o) / SUM(o) END, 2) + 0.0 AS fhv_high_flow_bias_pct
FROM op JOIN (SELECT catchment_id, quantile_cont(o, 0.98) AS t FROM op GROUP BY 1) USING (catchment_id) WHERE o >= t GROUP BY 1"""
_FLV = f"""SELECT catchment_id, round(CASE WHEN SUM(o) = 0 THEN 0.0 ELSE -100.0 * SUM(p - o) / SUM(o) END, 2) + 0.0 AS flv_low_flow_bias_pct FROM (
  SELECT catchment_id, lo - MIN(lo) OVER (PARTITION BY catchment_id) AS o, lp - MIN(lp) OVER (PARTITION BY catchment_id) AS p FROM (
    SELECT catchment_id, ln(o + eps) AS lo, ln(p + eps) AS lp FROM {_EPS} JOIN (SELECT catchment_id, quantile_cont(o, 0.3) AS t FROM op GROUP BY 1) USING (catchment_id) WHERE o <= t)) GROUP BY 1"""
_FMS = """SELECT catchment_id, round(CASE WHEN so = 0 THEN 0.0 ELSE 100.0 * (sp - so) / so END, 2) + 0.0 AS fms_mid_slope_bias_pct FROM (
  SELECT catchment_id, ln(so[a] + eps) - ln(so[b] + eps) AS so, ln(sp[a] + eps) - ln(sp[b] + eps) AS sp FROM (
    SELECT catchment_id, 0.01::DOUBLE * AVG(o) AS eps, list_reverse_sort(list(o)) AS so, list_reverse_sort(list(p)) AS sp,
      1 + least(CAST(floor(0.2::DOUBLE * COUNT(*)) AS BIGINT), COUNT(*) - 1) AS a, 1 + least(CAST(floor(0.7::DOUBLE * COUNT(*)) AS BIGINT), COUNT(*) - 1) AS b
    FROM op GROUP BY 1))"""


@query(with_(_LOG_NSE, "op"))
def log_nse(spark, folder):
    return scores.log_nse(_rows(spark, folder), [ENTITY])


@query(with_(_FHV, "op"))
def high_flow_bias(spark, folder):
    return scores.high_flow_bias(_rows(spark, folder), [ENTITY])


@query(with_(_FLV, "op"))
def low_flow_bias(spark, folder):
    return scores.low_flow_bias(_rows(spark, folder), [ENTITY])


@query(with_(_FMS, "op"))
def mid_slope_bias(spark, folder):
    return scores.mid_slope_bias(_rows(spark, folder), [ENTITY])


@query(
    rounded_sql(
        "SELECT catchment_id, CASE WHEN AVG(precipitation_mm) > 0 THEN AVG(o) / AVG(precipitation_mm) ELSE 0.0 END AS runoff_ratio FROM op GROUP BY 1",
        "catchment_id",
        "runoff_ratio",
        "op",
    )
)
def runoff_ratio(spark, folder):
    return rounded(scores.runoff_ratio(scores.scored(X.predictions(spark, folder)), [ENTITY]))


_PEAK_RATE = f"SELECT catchment_id, round(AVG(hit), 4) + 0.0 AS peak_timing_hit_rate FROM ({PEAKS_SQL}) GROUP BY 1"


@query(with_(_PEAK_RATE, "scored"))
def peak_hit_rate(spark, folder):
    return scores.peak_hit_rate(_rows(spark, folder))


def _bfi_sql() -> str:
    """Both baseflow indices: the two recursive filters stand side by side under different names."""
    observed = baseflow_query("y_true", "op_named", "").strip()
    predicted = baseflow_query("y_pred", "op_named", "").strip()
    tail = predicted[predicted.index("q0 AS MATERIALIZED") :]
    for old in ("q0", "p0", "p1", "p2"):
        tail = tail.replace(old, f"z{old}")
    return f"{observed},\n{tail}"


fragment("op_named", "SELECT catchment_id, date, y_true, y_pred FROM scored", "scored")


@query(
    f"""{_bfi_sql()},
op AS (SELECT catchment_id, date, y_true AS o, y_pred AS p, precipitation_mm FROM scored),
bo AS (SELECT catchment_id, round(CASE WHEN SUM(q) > 0 THEN SUM(bf) / SUM(q) ELSE 0.0 END, 4) + 0.0 AS bfi_observed FROM p2 GROUP BY 1),
bp AS (SELECT catchment_id, round(CASE WHEN SUM(q) > 0 THEN SUM(bf) / SUM(q) ELSE 0.0 END, 4) + 0.0 AS bfi_predicted FROM zp2 GROUP BY 1),
rr AS (SELECT catchment_id, round(CASE WHEN AVG(precipitation_mm) > 0 THEN AVG(o) / AVG(precipitation_mm) ELSE 0.0 END, 4) + 0.0 AS runoff_ratio_observed,
  round(CASE WHEN AVG(precipitation_mm) > 0 THEN AVG(p) / AVG(precipitation_mm) ELSE 0.0 END, 4) + 0.0 AS runoff_ratio_predicted FROM op GROUP BY 1)
SELECT * FROM ({_LOG_NSE}) JOIN ({_FHV}) USING (catchment_id) JOIN ({_FLV}) USING (catchment_id) JOIN ({_FMS}) USING (catchment_id)
JOIN bo USING (catchment_id) JOIN bp USING (catchment_id) JOIN ({_PEAK_RATE}) USING (catchment_id) JOIN rr USING (catchment_id)"""
)
def signature_suite(spark, folder):
    rows = X.predictions(spark, folder).select(ENTITY, DATE, OBS, PRED, PRECIP)
    return scores.signature_suite(rows, PRECIP)


def _pooled(sql: str) -> str:
    """A per-entity signature turned into one over all rows."""
    out = sql.replace("SELECT catchment_id, quantile_cont", "SELECT quantile_cont").replace("FROM op GROUP BY 1)", "FROM op)")
    out = out.replace("USING (catchment_id)", "ON true").replace("OVER (PARTITION BY catchment_id)", "OVER ()")
    out = out.replace("SELECT op.catchment_id, ", "SELECT ").replace("SELECT catchment_id, ", "SELECT ")
    return out.replace(" GROUP BY 1", "")


@query(with_(f"SELECT * FROM ({_pooled(_LOG_NSE)}) JOIN ({_pooled(_FHV)}) ON true JOIN ({_pooled(_FLV)}) ON true JOIN ({_pooled(_FMS)}) ON true", "op"))
def signatures_pooled(spark, folder):
    rows = scores.scored(_rows(spark, folder))
    parts = [scores.log_nse(rows), scores.high_flow_bias(rows), scores.low_flow_bias(rows), scores.mid_slope_bias(rows)]
    out = parts[0]
    for part in parts[1:]:
        out = scores.attach(out, part)
    return out


def _cells(table: str, section: str, scope: str, names: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT 'persist' AS model, '{section}' AS section, CAST({scope} AS VARCHAR) AS scope, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {table}"
        for n in names.split()
    )


@query(
    f"""{_bfi_sql()},
op AS (SELECT catchment_id, date, y_true AS o, y_pred AS p, precipitation_mm FROM scored),
overall AS (SELECT {X.SUITE}, COUNT(*) AS n_test_samples FROM op),
extremes AS ({_scope_sql("", "ON true")}),
regimes AS (SELECT regime, {X.SUITE}, COUNT(*) AS n_samples FROM (SELECT o, p, CASE {_REGIME_CASE} END AS regime FROM op JOIN ({_CUTS}) ON true)
  WHERE regime IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 5),
sig AS (SELECT * FROM ({_pooled(_LOG_NSE)}) JOIN ({_pooled(_FHV)}) ON true JOIN ({_pooled(_FLV)}) ON true JOIN ({_pooled(_FMS)}) ON true
  JOIN (SELECT round(SUM(bf) / SUM(q), 4) + 0.0 AS bfi_observed FROM p2) ON true JOIN (SELECT round(SUM(bf) / SUM(q), 4) + 0.0 AS bfi_predicted FROM zp2) ON true
  JOIN (SELECT round(AVG(hit), 4) + 0.0 AS peak_timing_hit_rate FROM ({PEAKS_SQL})) ON true)
{_cells("overall", "overall_metrics", "'all'", "nse kge rmse pbias r2 n_test_samples")}
UNION ALL
{_cells("extremes", "extreme_event_metrics", "scope", "nse kge rmse pbias r2 n_events")}
UNION ALL
{_cells("regimes", "flow_regime_metrics", "regime", "nse kge rmse pbias r2 n_samples")}
UNION ALL
{_cells("sig", "hydrological_signatures", "'all'", "log_nse fhv_high_flow_bias_pct flv_low_flow_bias_pct fms_mid_slope_bias_pct bfi_observed bfi_predicted peak_timing_hit_rate")}"""
)
def evaluate_predictions(spark, folder):
    return scores.evaluate_predictions(_rows(spark, folder), "persist")


# --- curves and lines --------------------------------------------------------------------------


@query(
    rounded_sql(
        """SELECT catchment_id, side, flow, rank, rank / n * 100 AS exceedance_pct FROM (
  SELECT catchment_id, side, flow, row_number() OVER (PARTITION BY catchment_id, side ORDER BY flow DESC) AS rank,
    COUNT(*) OVER (PARTITION BY catchment_id, side) AS n FROM (
      SELECT catchment_id, 'observed' AS side, o AS flow FROM op UNION ALL SELECT catchment_id, 'predicted', p FROM op))""",
        "catchment_id side flow rank",
        "exceedance_pct",
        "op",
    )
)
def flow_duration_curve(spark, folder):
    sides = F.array(
        F.struct(F.lit("observed").alias("side"), F.col(OBS).alias("flow")),
        F.struct(F.lit("predicted").alias("side"), F.col(PRED).alias("flow")),
    )
    long = scores.scored(_rows(spark, folder)).select(ENTITY, F.explode(sides).alias("x")).select(ENTITY, "x.*")
    return rounded(scores.flow_duration_curve(long, "flow", [ENTITY, "side"]))


@query(
    rounded_sql(
        """SELECT flow, n_equal, last_rank - n_equal + 1 AS first_rank, last_rank, last_rank / n * 100 AS exceedance_pct FROM (
  SELECT o AS flow, COUNT(*) AS n_equal, CAST(SUM(COUNT(*)) OVER (ORDER BY o DESC) AS BIGINT) AS last_rank, SUM(COUNT(*)) OVER () AS n FROM op GROUP BY 1)""",
        "flow n_equal first_rank last_rank",
        "exceedance_pct",
        "op",
    )
)
def flow_duration_curve_pooled(spark, folder):
    rows = scores.scored(_rows(spark, folder)).select(F.col(OBS).alias("flow"))
    return rounded(scores.flow_duration_curve(rows, "flow", []))


@query(
    rounded_sql(
        "SELECT catchment_id, regr_slope(p, o) AS slope, regr_intercept(p, o) AS intercept, CAST(regr_count(p, o) AS BIGINT) AS n FROM op GROUP BY 1",
        "catchment_id n",
        "slope intercept",
        "op",
    )
)
def fit_line(spark, folder):
    return rounded(scores.fit_line(scores.scored(_rows(spark, folder)), [ENTITY]))


@query(with_("SELECT catchment_id, date, o AS y_true, p AS y_pred, o - p AS residual FROM op", "op"))
def residuals(spark, folder):
    return scores.residuals(scores.scored(_rows(spark, folder)))
