"""Hand-computed metric cases."""

import pytest
from pyspark.sql import functions as F

from daypanel.functions.errors import Errors
from daypanel.operators import baseflow, scores

EVENT_O = [0, 0, 1, 2, 4, 8, 16, 3, 2, 1]
EVENT_P = [0, 0.5, 1, 2, 3, 9, 12, 4, 2, 1]


def suite(df):
    e = Errors("y_true", "y_pred")
    return df.agg(*e.suite(None)).head().asDict()


@pytest.mark.parametrize(
    ("obs", "pred", "want"),
    [
        ([1, 2, 3, 4], [1, 2, 3, 5], {"nse": 0.8, "kge": 0.661551, "rmse": 0.5, "pbias": -10}),
        ([0, 0, 0, 0], [0, 0.1, 0, 0.1], {"nse": 0, "kge": -0.732051, "rmse": 0.070711, "pbias": 0}),
        (EVENT_O, EVENT_P, {"nse": 0.911738, "kge": 0.791257, "rmse": 1.387444, "pbias": 6.756757}),
    ],
)
def test_suite(pairs, obs, pred, want):
    got = suite(pairs(obs, pred))
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-6), name
    assert got["r2"] == got["nse"]


def test_constant_prediction_has_no_kge(pairs):
    got = suite(pairs([1, 2, 3], [2, 2, 2]))
    assert got["kge"] is None
    assert got["nse"] == pytest.approx(0.0)


def test_no_rows_give_null(pairs):
    assert suite(pairs([1.0], [1.0]).where("false"))["nse"] is None


def test_log_nse_without_any_flow(pairs):
    df = pairs([0, 0, 0], [0, 0.5, 0])
    assert scores.log_nse(df).head()["log_nse"] == 0.0
    assert scores.log_nse(df, ["catchment_id"]).head()["log_nse"] == 0.0


def test_missing_predictions_are_left_out(pairs):
    df = pairs([1, 2, 3, 4, 9], [1, 2, 3, 5, None])
    assert scores.metric_suite(df, count="n").head()["n"] == 4
    assert scores.metric_suite(df).head()["nse"] == 0.8


def test_signatures_of_the_event(pairs):
    df = pairs(EVENT_O, EVENT_P)
    by = ["catchment_id"]
    assert scores.log_nse(df, by).head()["log_nse"] == pytest.approx(0.8021, abs=1e-4)
    assert scores.high_flow_bias(df, by).head()["fhv_high_flow_bias_pct"] == -25.0
    assert scores.low_flow_bias(df, by, digits=6).head()["flv_low_flow_bias_pct"] == pytest.approx(-40.128177, abs=1e-6)
    assert scores.mid_slope_bias(df, by).head()["fms_mid_slope_bias_pct"] == 0.0
    assert scores.peak_hit_rate(df).head()["peak_timing_hit_rate"] == 0.0
    assert baseflow.baseflow_index(df, "y_true").head()["bfi"] == pytest.approx(0.399476, abs=1e-6)
    assert baseflow.baseflow_index(df, "y_pred").head()["bfi"] == pytest.approx(0.228818, abs=1e-6)


def test_pooled_signatures_equal_per_entity_for_one_entity(pairs):
    df = pairs(EVENT_O, EVENT_P)
    for f in (scores.log_nse, scores.high_flow_bias, scores.low_flow_bias, scores.mid_slope_bias):
        assert f(df).head()[0] == f(df, ["catchment_id"]).head()[1]


def test_regimes_lose_only_the_maximum(pairs):
    obs = [float(i) for i in range(1, 101)]
    rows = scores.flow_regime_metrics(pairs(obs, obs)).collect()
    assert sum(r["n_samples"] for r in rows) == 99
    assert {r["regime"] for r in rows} == set(scores.REGIMES)


def test_scopes_need_more_than_five_events(pairs):
    few = scores.extreme_metrics(pairs(range(20), range(20))).collect()
    assert [r["scope"] for r in few] == ["overall"]
    many = scores.extreme_metrics(pairs(range(200), range(200))).collect()
    assert sorted(r["scope"] for r in many) == ["drought_events", "flood_events", "overall"]


def test_evaluation_lists_every_section(pairs):
    rows = scores.evaluate_predictions(pairs(range(200), range(200))).collect()
    assert {r["section"] for r in rows} == {
        "overall_metrics",
        "extreme_event_metrics",
        "flow_regime_metrics",
        "hydrological_signatures",
    }
    assert {r["value"] for r in rows if r["metric"] == "nse" and r["section"] == "overall_metrics"} == {1.0}


def test_negative_predictions_are_clamped(pairs):
    df = pairs([0, 1, 2], [-5, 1, 2])
    assert scores.metric_suite(df).head()["nse"] == 1.0
    assert scores.scored(df).agg(F.min("y_pred")).head()[0] == 0.0
