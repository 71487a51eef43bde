"""Sources, panel operators, fitted steps and validation jobs on small fixtures."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from daypanel.functions import scalar as S
from daypanel.modelling import explain, quantile_regression, search, validation
from daypanel.operators import fitted, panel
from daypanel.sources import readers, state


def test_ids_lose_leading_zeros(spark):
    df = spark.createDataFrame([("03001",), ("x1",), ("12.0",)], "v string")
    assert [r[0] for r in df.select(S.normalize_id(F.col("v"), lenient=True)).collect()] == ["3001", "x1", "12"]
    assert df.limit(1).select(S.normalize_id(F.col("v"))).head()[0] == "3001"


def test_impossible_dates_are_null(spark):
    df = spark.createDataFrame([(2001, 2, 28), (2001, 2, 29), (2000, 2, 29), (2001, 13, 1)], "y int, m int, d int")
    got = [r[0] for r in df.select(S.date_from_parts(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert [g is None for g in got] == [False, True, False, True]


def test_a_missing_prediction_is_not_clamped_to_zero(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(S.clamp_nonnegative(F.col("v"))).collect()] == [None, 0.0, 2.0]


def test_invalid_area_drops_the_entity(spark):
    rates = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 1.0)], "catchment_id string, q double")
    areas = spark.createDataFrame([("1", 86.4), ("2", 0.0), ("3", None)], "catchment_id string, area_km2 double")
    assert [(r["catchment_id"], round(r["d"], 9)) for r in panel.target_depth(rates, areas, "q", "d").collect()] == [("1", 1.0)]


def test_missing_prediction_file_gives_an_empty_table(spark, tmp_path):
    areas = spark.createDataFrame([("1", 1.0)], "catchment_id string, area_km2 double")
    for path in (None, str(tmp_path / "nothing.csv")):
        got = readers.read_predictions(spark, path, areas)
        assert got.columns == ["catchment_id", "date", "baseline_mm_day"]
        assert got.count() == 0


def test_series_files_with_ids_in_their_names(spark, tmp_path):
    for name, rain in (("03001", 1.5), ("00042", 2.5)):
        (tmp_path / f"{name}.csv").write_text(f"year,month,day,PRCP(mm/day),other\n2001,1,2,{rain},9\n")
    rows = readers.read_entity_series(spark, str(tmp_path)).orderBy("catchment_id").collect()
    assert [(r["catchment_id"], str(r["date"]), r["precipitation_mm"]) for r in rows] == [
        ("3001", "2001-01-02", 1.5),
        ("42", "2001-01-02", 2.5),
    ]


def test_flat_column_is_scaled_to_zero(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 3.0)], "flat double, x double")
    for fit, want in ((fitted.fit_standard, [-1.0, 1.0]), (fitted.fit_minmax, [0.0, 1.0])):
        out = fitted.scale_columns(df, fit(df, ["flat", "x"]).collect()).collect()
        assert [r["flat"] for r in out] == [0.0, 0.0]
        assert sorted(r["x"] for r in out) == want


def test_sparse_limit_is_strict(spark):
    rows = [(None if i < 3 else 1.0, None if i < 4 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert fitted.fit_sparse(df, 0.3, ["a", "b"]) == ["b"]


@pytest.fixture(scope="module")
def noisy(spark):
    """Six entities whose target is linear in two inputs, with different offsets and noise."""
    rng = np.random.default_rng(3)
    rows = []
    for e in range(6):
        for i in range(60):
            x1, x2 = (float(v) for v in rng.normal(size=2))
            rows.append((e, i, x1, x2, float(max(0.0, 20 + 3 * x1 - 2 * x2 + 0.5 * e + rng.normal()))))
    df = spark.createDataFrame(rows, "catchment_id long, i int, x1 double, x2 double, streamflow_mm_day double")
    return df.selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", "x1", "x2", "streamflow_mm_day").cache()


def test_closed_form_equals_refitting_each_fold(noisy):
    fast = validation.leave_one_out_linear(noisy, ["x1", "x2"]).orderBy("held_out").collect()
    slow = validation.leave_one_entity_out(noisy, lambda: LinearRegression(), ["x1", "x2"]).orderBy("held_out").collect()
    assert len(fast) == len(slow) == 6
    for a, b in zip(fast, slow, strict=True):
        assert a["held_out"] == b["held_out"]
        assert a["nse"] == pytest.approx(b["nse"], abs=1e-3)
        assert a["n_test"] == 60


def test_search_keeps_failed_trials_and_finds_the_best(noisy):
    spaces = {"linear": {"regParam": {"type": "categorical", "choices": [0.0, -5.0]}}}
    found = search.fit_models(noisy, ["x1", "x2"], folds=2, n_trials=6, families=["linear"], spaces=spaces)
    trials = found.trials.collect()
    assert len(trials) == 6
    assert {t["error"] is None for t in trials} == {True, False}
    assert found.best_score > 0.7
    assert found.model is not None


def test_trial_parameters_are_repeatable():
    a = search.trial_table(search.SEARCH_SPACES["boosted_trees"], 100, seed=1)
    assert len(a) == 100
    assert a == search.trial_table(search.SEARCH_SPACES["boosted_trees"], 100, seed=1)
    assert all(3 <= p["maxDepth"] < 15 and 0.01 <= p["stepSize"] <= 0.3 for p in a)


def test_importance_ranks_the_stronger_input_first(noisy):
    model = search.model_stages(LinearRegression(), ["x1", "x2"]).fit(noisy)
    rows = {r["feature"]: r["importance"] for r in explain.permutation_importance(noisy, model, ["x1", "x2"]).collect()}
    assert rows["x1"] > rows["x2"] > 0


def test_partial_dependence_of_a_linear_model_is_its_slope(noisy):
    model = search.model_stages(LinearRegression(), ["x1", "x2"]).fit(noisy)
    rows = explain.partial_dependence(noisy, model, ["x1"], ["x1", "x2"], points=5).orderBy("value").collect()
    assert len(rows) == 5
    slope = (rows[-1]["mean_prediction"] - rows[0]["mean_prediction"]) / (rows[-1]["value"] - rows[0]["value"])
    assert slope == pytest.approx(model.stages[-1].coefficients[0], rel=1e-6)


def test_quantile_regression_covers_its_share(noisy):
    model = quantile_regression.fit_quantile(noisy, ["x1", "x2"], 0.9, max_rounds=25)
    below = model.transform(noisy).agg(F.avg((F.col("streamflow_mm_day") <= F.col("prediction")).cast("double"))).head()[0]
    assert 0.85 <= below <= 0.95


def test_incomplete_state_is_refused(spark, noisy, tmp_path):
    model = search.model_stages(LinearRegression(), ["x1", "x2"]).fit(noisy)
    params = spark.createDataFrame([("x1", 0, False, 0.0, 0.0, 1.0)], fitted.PARAMS_SCHEMA)
    state.save_params(str(tmp_path / "full"), params, model, {"score": 1})
    assert state.load_params(spark, str(tmp_path / "full"))[2] == {"score": 1}
    params.write.parquet(str(tmp_path / "half" / "params"))
    with pytest.raises(FileNotFoundError):
        state.load_params(spark, str(tmp_path / "half"))
