"""One-pass evaluation against the single metrics, array baseflow against a plain loop, running ranks inside one value range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.operators import baseflow, order, scores, series


def plain_slow_part(flow, alpha=baseflow.ALPHA, passes=baseflow.PASSES):
    """Day by day, one series."""
    total = [max(q, 0.0) for q in flow]
    slow = list(total)
    for number in range(passes):
        quick, neighbour = 0.0, None
        for day in range(len(total)) if number % 2 == 0 else reversed(range(len(total))):
            if neighbour is not None:
                quick = max(alpha * quick + (1 + alpha) / 2 * (slow[day] - neighbour), 0.0)
                if quick < total[day]:
                    slow[day] = min(slow[day], total[day] - quick)
            neighbour = slow[day]
    return slow


@pytest.fixture
def many(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(40):
        for day in range(int(rng.integers(1, 120))):
            o, p = rng.gamma(1.5, 3.0, 2)
            rows.append((None if e == 0 else f"e{e}", day, float(o) if day % 7 else 0.0, float(p - 1)))
    df = spark.createDataFrame(rows, "catchment_id string, i int, y_true double, y_pred double")
    return df.selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", "y_true", "y_pred")


def test_array_baseflow_equals_the_plain_loop():
    rng = np.random.default_rng(3)
    flows = [rng.gamma(1.0, 2.0, n) - 0.3 for n in (1, 2, 300, 5, 170, 299, 2, 40)]
    for flow, slow in zip(flows, baseflow.slow_parts(flows), strict=True):
        assert slow.tolist() == plain_slow_part(flow.tolist())


@pytest.mark.parametrize("bucket", [1, 50, 100_000])
def test_baseflow_does_not_depend_on_buckets(many, monkeypatch, bucket):
    monkeypatch.setattr(baseflow, "BUCKET_ROWS", bucket)
    found = {(r["catchment_id"], r["date"]): (r["a"], r["b"]) for r in baseflow.baseflows(many, {"y_true": "a", "y_pred": "b"}).collect()}
    lists = {}
    for r in sorted(many.collect(), key=lambda r: r["date"]):
        lists.setdefault(r["catchment_id"], []).append(r)
    assert len(found) == sum(map(len, lists.values()))
    for key, rows in lists.items():
        for i, column in enumerate(("y_true", "y_pred")):
            expected = plain_slow_part([r[column] for r in rows])
            assert [found[key, r["date"]][i] for r in rows] == expected


def test_sequence_totals_count_peaks_like_the_window_form(many):
    rows = scores.scored(many).where("catchment_id IS NOT NULL")
    window = {r["catchment_id"]: (r["n"], r["h"]) for r in series.peak_hits(rows).groupBy("catchment_id").agg(F.count("*").alias("n"), F.sum("hit").alias("h")).collect()}
    assert {r["catchment_id"]: (r["peaks"], r["hits"]) for r in baseflow.sequence_totals(rows).collect()} == window


@pytest.mark.parametrize("materialize", [True, False])
def test_evaluation_equals_the_single_metrics(many, materialize):
    found = {(r["section"], r["scope"], r["metric"]): r["value"] for r in scores.evaluate_predictions(many, materialize=materialize).collect()}
    signatures = {m: v for (s, _, m), v in found.items() if s == "hydrological_signatures"}
    single = [scores.log_nse(many), scores.high_flow_bias(many), scores.low_flow_bias(many), scores.mid_slope_bias(many)]
    for name, value in [(t.columns[0], t.head()[0]) for t in single]:
        assert signatures[name] == pytest.approx(value, abs=1e-9)
    for table, section, scope, count in (
        (scores.extreme_metrics(many), "extreme_event_metrics", "scope", "n_events"),
        (scores.flow_regime_metrics(many), "flow_regime_metrics", "regime", "n_samples"),
    ):
        rows = table.collect()
        assert {k[1] for k in found if k[0] == section} == {r[scope] for r in rows}
        for r in rows:
            for m in ("nse", "kge", "rmse", "pbias", "r2", count):
                assert found[section, r[scope], m] == pytest.approx(r[m], abs=1e-3)


def test_evaluation_without_rows(many):
    found = {(r["section"], r["metric"]): r["value"] for r in scores.evaluate_predictions(many.where("false")).collect()}
    assert found["overall_metrics", "n_test_samples"] == 0 and found["overall_metrics", "nse"] is None
    assert {"log_nse", "fhv_high_flow_bias_pct", "bfi_observed"} <= {m for s, m in found if s == "hydrological_signatures"}


def test_a_null_group_has_thresholds_like_any_other(many):
    by = many.withColumn("g", F.when(F.col("catchment_id") > "e2", "x"))
    found = {r["g"]: r["q"] for r in order.quantiles(by, "y_true", {"q": 0.5}, ["g"], null_groups=True).collect()}
    for key in (None, "x"):
        values = [r["y_true"] for r in by.collect() if r["g"] == key]
        assert found[key] == pytest.approx(float(np.quantile(values, 0.5)), abs=1e-12)
    assert scores.extreme_metrics(by, by=["g"]).where("scope = 'overall'").count() == 2


def test_pooled_curve_inside_one_value_range(spark):
    values = [1.0 + i % 997 / 1e5 for i in range(3000)] + [5.0, 0.0, -2.0]
    df = spark.createDataFrame([(v,) for v in values], "flow double")
    found = {r["flow"]: (r["first_rank"], r["last_rank"], r["n_equal"]) for r in scores.flow_duration_curve(df, "flow", []).collect()}
    assert found == {v: (sum(w > v for w in values) + 1, sum(w >= v for w in values), values.count(v)) for v in set(values)}
    flat = spark.createDataFrame([(1.0 + i % 997 / 1e5,) for i in range(3000)], "flow double").withColumn("_range", order.value_range(F.col("flow")))
    steps = flat.selectExpr("flow", "1.0D AS _lo", "1.00996D AS _hi").select(order.range_step(F.col("flow")).alias("s"))
    assert flat.select("_range").distinct().count() == 1 and steps.distinct().count() > 500
