"""Error metrics of predictions, for all rows or any grouping.

Input is ``(entity, date, y_true, y_pred, ...)``. Functions with ``by=()`` score all rows as one
group; thresholds of such groups come from the distributed order statistics, and the metrics
themselves are mergeable moments, so no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.errors import Errors
from daypanel.functions.scalar import clamp_nonnegative
from daypanel.operators import baseflow as bf
from daypanel.operators import series
from daypanel.operators.order import attach, join_groups, order_statistics, quantiles, range_step, series_quantiles, value_range
from daypanel.schema import DATE, ENTITY, OBS, PRECIP, PRED, REGIME_QUANTILES, REGIMES
from daypanel.session import durable

EPSILON = 0.01


def clamp_predictions(df: DataFrame, column: str = PRED) -> DataFrame:
    return df.withColumn(column, clamp_nonnegative(F.col(column)))


def scored(df: DataFrame) -> DataFrame:
    """Rows that can be scored: both values known, negative predictions raised to 0."""
    return clamp_predictions(df.where(F.col(OBS).isNotNull() & F.col(PRED).isNotNull()))


def _thresholds(df: DataFrame, probs: dict[str, float], by: Sequence[str], value: str = OBS) -> DataFrame:
    """Quantiles per group: the built-in aggregate where a group is one entity's series, else the distributed one. NULL is a group, as in the suite."""
    return series_quantiles(df, value, probs, by) if ENTITY in by else quantiles(df, value, probs, by, null_groups=True)


def metric_suite(df: DataFrame, by: Sequence[str] = (), digits: int | None = 4, count: str | None = None) -> DataFrame:
    """NSE, KGE, RMSE, PBIAS and R2 per group."""
    e = Errors(OBS, PRED)
    counted = [e.n().alias(count)] if count else []
    return scored(df).groupBy(*by).agg(*e.suite(digits), *counted)


def single_metric(df: DataFrame, name: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    value = getattr(Errors(OBS, PRED), name)()
    return scored(df).groupBy(*by).agg((F.round(value, digits) if digits is not None else value).alias(name))


def metrics_per_entity(df: DataFrame, min_rows: int = 10) -> DataFrame:
    return metric_suite(df, [ENTITY], count="n_samples").where(F.col("n_samples") >= min_rows)


def metrics_per_month(df: DataFrame, more_than: int = 10) -> DataFrame:
    e = Errors(OBS, PRED)
    months = scored(df).groupBy(F.month(DATE).alias("month"))
    return months.agg(F.round(e.nse(), 4).alias("nse"), e.n().alias("n_samples")).where(F.col("n_samples") > more_than)


def _scopes(scopes: dict[str, Column]) -> tuple[list[Column], Column]:
    """One struct of metrics per scope, all computed by the same aggregate, and their unfolding."""
    packed = []
    for name, condition in scopes.items():
        e = Errors(OBS, PRED, condition)
        packed.append(F.struct(F.lit(name).alias("scope"), *e.suite(), e.n().alias("n_events")).alias(f"s_{name}"))
    return packed, F.inline(F.array(*[f"s_{n}" for n in scopes]))


def extreme_flags(df: DataFrame, high: float = 0.95, low: float = 0.05, by: Sequence[str] = (), value: str = OBS) -> DataFrame:
    """Each row with its group's thresholds and whether it reaches them."""
    marked = attach(df, _thresholds(df, {"high_threshold": high, "low_threshold": low}, by, value), by)
    return marked.withColumn("is_flood", (F.col(value) >= F.col("high_threshold")).cast("int")).withColumn(
        "is_drought", (F.col(value) <= F.col("low_threshold")).cast("int")
    )


def extreme_metrics(
    df: DataFrame, flood: float = 95, drought: float = 5, by: Sequence[str] = (), more_than: int = 5
) -> DataFrame:
    """The suite over all rows, over floods and over droughts; the latter two only with enough events."""
    flagged = extreme_flags(scored(df), flood / 100.0, drought / 100.0, by)
    scopes = {
        "overall": F.lit(True),
        "flood_events": F.col("is_flood") == 1,
        "drought_events": F.col("is_drought") == 1,
    }
    packed, unfold = _scopes(scopes)
    rows = flagged.groupBy(*by).agg(*packed).select(*by, unfold)
    return rows.where((F.col("scope") == "overall") | (F.col("n_events") > more_than))


def regime_labels(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each row with its flow regime. Buckets are half open, the last one too, so the maximum has none."""
    cuts = {f"cut{i}": q for i, q in enumerate(REGIME_QUANTILES)}
    marked = attach(df, _thresholds(df, cuts, by), by)
    label = F.lit(None).cast("string")
    for i, name in enumerate(REGIMES):
        inside = (F.col(OBS) >= F.col(f"cut{i}")) & (F.col(OBS) < F.col(f"cut{i + 1}"))
        label = F.when(inside, F.lit(name)).otherwise(label)
    return marked.withColumn("regime", label).drop(*cuts)


def flow_regime_metrics(df: DataFrame, by: Sequence[str] = (), min_rows: int = 5) -> DataFrame:
    e = Errors(OBS, PRED)
    labelled = regime_labels(scored(df), by).where(F.col("regime").isNotNull())
    rows = labelled.groupBy(*by, "regime").agg(*e.suite(), e.n().alias("n_samples"))
    return rows.where(F.col("n_samples") >= min_rows)


# --- signatures --------------------------------------------------------------------------------


def with_offset(df: DataFrame, by: Sequence[str] = (), epsilon: float = EPSILON) -> DataFrame:
    """Add ``eps``, the small flow that keeps logarithms finite: a share of the mean, or a fixed amount."""
    if epsilon >= 1:
        return df.withColumn("eps", F.lit(float(epsilon)))
    return attach(df, df.groupBy(*by).agg((F.lit(epsilon) * F.avg(OBS)).alias("eps")), by)


def log_nse(df: DataFrame, by: Sequence[str] = (), epsilon: float = EPSILON, digits: int | None = 4) -> DataFrame:
    shifted = with_offset(scored(df), by, epsilon)
    e = Errors(F.ln(F.col(OBS) + F.col("eps")), F.ln(F.col(PRED) + F.col("eps")))
    # Without any flow the offset is 0 and there are no logs: no spread to explain, as in a constant series.
    value = F.coalesce(e.nse(), F.when(F.max("eps") <= 0, F.lit(0.0)))
    return shifted.groupBy(*by).agg((F.round(value, digits) if digits is not None else value).alias("log_nse"))


def high_flow_bias(df: DataFrame, by: Sequence[str] = (), quantile: float = 0.98, digits: int | None = 2) -> DataFrame:
    """Volume bias in percent over the rows at or above the high-flow quantile."""
    rows = scored(df)
    high = attach(rows, _thresholds(rows, {"limit": quantile}, by), by).where(F.col(OBS) >= F.col("limit"))
    total = F.sum(OBS)
    bias = F.when(total == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(100.0) * F.sum(F.col(PRED) - F.col(OBS)), total)
    )
    name = "fhv_high_flow_bias_pct"
    return high.groupBy(*by).agg((F.round(bias, digits) if digits is not None else bias).alias(name))


def low_flow_bias(
    df: DataFrame, by: Sequence[str] = (), quantile: float = 0.30, epsilon: float = EPSILON, digits: int | None = 2
) -> DataFrame:
    """Log-volume bias in percent over the lowest flows, each side measured from its own minimum."""
    rows = with_offset(scored(df), by, epsilon)
    low = attach(rows, _thresholds(rows, {"limit": quantile}, by), by).where(F.col(OBS) <= F.col("limit"))
    logs = low.select(
        *by, F.ln(F.col(OBS) + F.col("eps")).alias("_lo"), F.ln(F.col(PRED) + F.col("eps")).alias("_lp")
    )
    floors = logs.groupBy(*by).agg(F.min("_lo").alias("_min_o"), F.min("_lp").alias("_min_p"))
    above = attach(logs, floors, by).select(
        *by, (F.col("_lo") - F.col("_min_o")).alias("_o"), (F.col("_lp") - F.col("_min_p")).alias("_p")
    )
    total = F.sum("_o")
    bias = F.when(total == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(-100.0) * F.sum(F.col("_p") - F.col("_o")), total)
    )
    return above.groupBy(*by).agg(
        (F.round(bias, digits) if digits is not None else bias).alias("flv_low_flow_bias_pct")
    )


def _exceeded(share: float):
    """Position of the value that this share of the rows exceeds."""
    return lambda n: n - 1 - F.least(F.floor(n * F.lit(share)).cast("bigint"), n - 1)


def _both_sides(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observed and predicted values one below the other, with their ``side``."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in (OBS, PRED)])
    return rows.select(*by, F.inline(sides))


def mid_slope_bias(
    df: DataFrame,
    by: Sequence[str] = (),
    lower: float = 0.2,
    upper: float = 0.7,
    epsilon: float = EPSILON,
    digits: int | None = 2,
) -> DataFrame:
    """Bias in percent of the slope of the flow duration curve between two exceedance shares."""
    rows = scored(df)

    ends = order_statistics(_both_sides(rows, by), "value", {"steep": _exceeded(lower), "flat": _exceeded(upper)}, [*by, "side"], null_groups=True)

    def end(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side}_{name}")

    wide = ends.groupBy(*by).agg(*[end(s, n) for s in (OBS, PRED) for n in ("steep", "flat")])
    means = rows.groupBy(*by).agg((F.lit(epsilon) * F.avg(OBS) if epsilon < 1 else F.lit(float(epsilon))).alias("eps"))
    joined = attach(wide, means, by)

    def slope(side: str) -> Column:
        return F.ln(F.col(f"{side}_steep") + F.col("eps")) - F.ln(F.col(f"{side}_flat") + F.col("eps"))

    bias = F.when(slope(OBS) == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(100.0) * (slope(PRED) - slope(OBS)), slope(OBS))
    )
    name = "fms_mid_slope_bias_pct"
    return joined.select(*by, (F.round(bias, digits) if digits is not None else bias).alias(name))


def runoff_ratio(df: DataFrame, by: Sequence[str] = (), flow: str = OBS, precip: str = PRECIP, name: str = "runoff_ratio") -> DataFrame:
    """Mean flow per mean precipitation; 0 without rain."""
    rain = F.avg(precip)
    return df.groupBy(*by).agg(
        F.when(rain > 0, F.try_divide(F.avg(flow), rain)).otherwise(F.lit(0.0)).alias(name)
    )


def peak_hit_rate(df: DataFrame, quantile: float = 0.95, reach: int = 3, digits: int | None = 4) -> DataFrame:
    """Per entity: share of its observed peaks with a prediction that reaches the threshold nearby."""
    rate = F.avg("hit")
    hits = series.peak_hits(scored(df), quantile, reach)
    return hits.groupBy(ENTITY).agg((F.round(rate, digits) if digits is not None else rate).alias("peak_timing_hit_rate"))


def signature_suite(df: DataFrame, precip: str | None = None, materialize: bool = True) -> DataFrame:
    """All flow signatures per entity (sequence signatures have no meaning across entities).

    Each signature scans the predictions again, so they are written once to the shared folder first.
    """
    by = [ENTITY]
    rows = scored(df)
    if materialize:
        rows = durable(rows.select(ENTITY, DATE, OBS, PRED, *([precip] if precip else [])), "predictions")
    parts = [
        log_nse(rows, by),
        high_flow_bias(rows, by),
        low_flow_bias(rows, by),
        mid_slope_bias(rows, by),
        bf.baseflow_indices(rows, {OBS: "bfi_observed", PRED: "bfi_predicted"}),
        peak_hit_rate(rows),
    ]
    if precip:
        parts.append(runoff_ratio(rows, by, OBS, precip, "runoff_ratio_observed"))
        parts.append(runoff_ratio(rows, by, PRED, precip, "runoff_ratio_predicted"))
    out = parts[0]
    for part in parts[1:]:
        out = join_groups(out, part, [ENTITY], "left")
    rounded = [c for c in out.columns if c.startswith(("bfi_", "runoff_"))]
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in out.columns])


def pooled_cuts(rows: DataFrame, flood: float, drought: float, high: float = 0.98, low: float = 0.30, steep: float = 0.2, flat: float = 0.7) -> DataFrame:
    """One row with every threshold that the metrics of all rows ask for, both sides' flow duration ends included; two passes."""
    probs = {"flood": flood, "drought": drought, "high": high, "low": low} | {f"cut{i}": q for i, q in enumerate(REGIME_QUANTILES)}
    found = quantiles(_both_sides(rows), "value", probs, ["side"], {"steep": _exceeded(steep), "flat": _exceeded(flat)})
    first = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    ends = [first(s, n).alias(f"{s}_{n}") for s in (OBS, PRED) for n in ("steep", "flat")]
    return found.groupBy().agg(*[first(OBS, name).alias(name) for name in probs], *ends)


def pooled_scopes(rows: DataFrame, cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per scope with the metric suite, ``n`` and what the flow signatures of all rows are made of; one pass.

    A row counts in each scope that it belongs to: all rows, flood and drought events, its flow regime (``regime_...``), high and low flow.
    ``totals`` is the one row of :func:`sequence_row`; its mean flow gives the offset of the logarithms.
    """
    marked = attach(rows, attach(cuts, totals))
    regimes = [
        F.when((F.col(OBS) >= F.col(f"cut{i}")) & (F.col(OBS) < F.col(f"cut{i + 1}")), F.lit(f"regime_{name}")) for i, name in enumerate(REGIMES)
    ]
    labels = [
        F.lit("overall"),
        F.when(F.col(OBS) >= F.col("flood"), F.lit("flood_events")),
        F.when(F.col(OBS) <= F.col("drought"), F.lit("drought_events")),
        F.when(F.col(OBS) >= F.col("high"), F.lit("high_flow")),
        F.when(F.col(OBS) <= F.col("low"), F.lit("low_flow")),
        *regimes,
    ]
    scoped = marked.select(OBS, PRED, "eps", F.explode(F.array_compact(F.array(*labels))).alias("scope"))
    e = Errors(OBS, PRED)
    log_o, log_p = F.ln(F.col(OBS) + F.col("eps")), F.ln(F.col(PRED) + F.col("eps"))
    log_score = F.coalesce(Errors(log_o, log_p).nse(), F.when(F.max("eps") <= 0, F.lit(0.0)))
    volume = F.when(F.sum(OBS) == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * F.sum(F.col(PRED) - F.col(OBS)), F.sum(OBS)))
    # Logarithms are measured from the smallest of their side; with one observed value there is nothing above it.
    above_o = F.sum(log_o) - F.count(log_o) * F.min(log_o)
    above_p = F.sum(log_p) - F.count(log_p) * F.min(log_p)
    low = F.when(F.min(log_o) == F.max(log_o), F.lit(0.0)).otherwise(F.try_divide(F.lit(-100.0) * (above_p - above_o), above_o))
    return scoped.groupBy("scope").agg(
        *e.suite(), e.n().alias("n"), F.round(log_score, 4).alias("log_nse"), F.round(volume, 2).alias("volume_bias"), F.round(low, 2).alias("low_bias")
    )


def sequence_row(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Sequence signatures of all entities together, each series on its own and then totals, and ``eps``, a share of the mean flow; one pass."""
    totals = bf.sequence_totals(df)
    share = lambda side: F.round(
        F.when(F.sum(f"total_{side}") > 0, F.try_divide(F.sum(f"slow_{side}"), F.sum(f"total_{side}"))).otherwise(F.lit(0.0)), 4
    )
    return totals.agg(
        (F.lit(epsilon) * F.try_divide(F.sum("flow"), F.sum("rows"))).alias("eps"),
        share("obs").alias("bfi_observed"),
        share("pred").alias("bfi_predicted"),
        F.round(F.try_divide(F.sum("hits"), F.sum("peaks")), 4).alias("peak_timing_hit_rate"),
    )


def _slope_bias() -> Column:
    """Bias in percent of the slope between the flow duration ends of :func:`pooled_cuts`."""
    ends = {s: [F.ln(F.col(f"{s}_{n}") + F.col("eps")) for n in ("steep", "flat")] for s in (OBS, PRED)}
    seen, guessed = (ends[s][0] - ends[s][1] for s in (OBS, PRED))
    return F.round(F.when(seen == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(100.0) * (guessed - seen), seen)), 2)


def evaluate_predictions(df: DataFrame, model: str = "model", materialize: bool = True, flood: float = 95, drought: float = 5) -> DataFrame:
    """The complete evaluation as long rows ``(model, section, scope, metric, value)``.

    The predictions are written once to the shared folder and scanned four times: one pass in date order, two for all thresholds
    together, one for all metrics. Without any row the pooled metrics are NULL and the counts 0.
    """
    rows = scored(df).select(ENTITY, DATE, F.col(OBS).cast("double").alias(OBS), F.col(PRED).cast("double").alias(PRED))
    single = lambda table, label: durable(table, label) if materialize else table
    rows = single(rows, "predictions")
    totals = single(sequence_row(rows), "sequence")
    cuts = single(pooled_cuts(rows, flood / 100.0, drought / 100.0), "cuts")
    named = ["overall", "flood_events", "drought_events", "high_flow", "low_flow", *[f"regime_{r}" for r in REGIMES]]
    scopes = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in named])).alias("scope"))
    table = scopes.join(pooled_scopes(rows, cuts, totals), "scope", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = attach(table, attach(cuts, totals).select("*", _slope_bias().alias("slope_bias")).drop("flood", "drought", "high", "low"))

    def cells(section: str, scope: Column, values: dict[str, Column]) -> Column:
        return F.array(*[
            F.struct(F.lit(section).alias("section"), scope.alias("scope"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for m, v in values.items()
        ])

    suite = {m: F.col(m) for m in ("nse", "kge", "rmse", "pbias", "r2")}
    everything, scope = F.lit("all"), F.col("scope")
    signatures = "hydrological_signatures"
    sequence = {m: F.col(m) for m in ("bfi_observed", "bfi_predicted", "peak_timing_hit_rate")}
    whole = F.concat(
        cells("overall_metrics", everything, suite | {"n_test_samples": F.col("n")}),
        cells("extreme_event_metrics", scope, suite | {"n_events": F.col("n")}),
        cells(signatures, everything, {"log_nse": F.col("log_nse"), "fms_mid_slope_bias_pct": F.col("slope_bias")} | sequence),
    )
    regime = cells("flow_regime_metrics", F.substring_index(scope, "regime_", -1), suite | {"n_samples": F.col("n")})
    shown = (
        F.when(scope == "overall", whole)
        .when((scope == "high_flow"), cells(signatures, everything, {"fhv_high_flow_bias_pct": F.col("volume_bias")}))
        .when((scope == "low_flow"), cells(signatures, everything, {"flv_low_flow_bias_pct": F.col("low_bias")}))
        .when(scope.startswith("regime_") & (F.col("n") >= 5), regime)
        .when(scope.endswith("_events") & (F.col("n") > 5), cells("extreme_event_metrics", scope, suite | {"n_events": F.col("n")}))
    )
    return table.select(F.lit(model).alias("model"), F.inline(shown))


def flow_duration_curve(df: DataFrame, value: str, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Values with the percent of time they are reached: ``rank / n * 100``, rank 1 = largest.

    Equal values are counted before they are ordered. Per entity every row is listed with its own
    rank; for larger groups a value is one row, with the range of ranks ``first_rank .. last_rank``
    that its ``n_equal`` rows share (the last rank gives ``exceedance_pct``).
    """
    keys = list(by)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n_equal"))
        .withColumn("_range", value_range(F.col(value)))
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranges = counted.groupBy(*keys, "_range").agg(F.sum("n_equal").alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    earlier = whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    above = ranges.select(
        *keys,
        "_range",
        "_lo",
        "_hi",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_above"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    placed = join_groups(counted, above, [*keys, "_range"])
    part, start = [*keys, "_range"], F.col("_above")
    if ENTITY not in keys:  # a range may hold most values of a group of any size; one entity's values are bounded by the calendar
        placed = placed.withColumn("_step", range_step(F.col(value)))
        larger = Window.partitionBy(*part).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
        steps = placed.groupBy(*part, "_step").agg(F.sum("n_equal").alias("_step_rows"))
        steps = steps.select(*part, "_step", F.coalesce(F.sum("_step_rows").over(larger), F.lit(0)).alias("_larger"))
        part, start = [*part, "_step"], start + F.col("_larger")
        placed = join_groups(placed, steps, part)
    inside = Window.partitionBy(*part).orderBy(F.desc(value))
    ranked = placed.withColumn("last_rank", F.sum("n_equal").over(inside) + start)
    first = F.col("last_rank") - F.col("n_equal") + 1

    def share(rank: Column) -> Column:
        return (F.try_divide(rank, F.col("_n")) * 100).alias("exceedance_pct")

    if ENTITY in keys:
        listed = ranked.select(*keys, value, "_n", F.explode(F.sequence(first, F.col("last_rank"))).alias("rank"))
        return listed.select(*keys, value, "rank", share(F.col("rank")))
    return ranked.select(*keys, value, "n_equal", first.alias("first_rank"), "last_rank", share(F.col("last_rank")))


def fit_line(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the predictions over the observations."""
    return df.groupBy(*by).agg(
        F.regr_slope(PRED, OBS).alias("slope"), F.regr_intercept(PRED, OBS).alias("intercept"), F.regr_count(PRED, OBS).alias("n")
    )


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col(OBS) - F.col(PRED))
