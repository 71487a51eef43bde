"""Risk scores and prediction intervals on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from daypanel.operators import compare, intervals, profiles, risk


def test_risk_of_a_ramp(series_of):
    df = series_of("y_pred", list(range(1, 41)), list(range(10)))
    rows = risk.risk_scores(df).collect()
    assert len(rows) == 1  # the short series is not scored
    row = rows[0]
    assert (row["flood_risk_score"], row["drought_risk_score"], row["combined_risk_score"]) == (0.5148, 0.5746, 0.5447)
    assert {row[f"{k}_risk_level"] for k in ("flood", "drought", "combined")} == {"Moderate"}


def test_levels_are_strictly_below_their_cut(spark):
    scores = spark.createDataFrame([(0.0,), (0.2,), (0.79,), (0.8,), (1.0,)], "s double")
    got = [r[0] for r in scores.select(risk.risk_level(F.col("s"))).collect()]
    assert got == ["Very Low", "Low", "High", "Very High", "Very High"]


def test_risk_counts_and_order(spark):
    rows = [("a", 0.1, "Low", 0.9, "High", "x"), ("b", 0.5, "High", 0.1, "Low", "x"), ("c", 0.3, "Low", 0.2, "Low", None)]
    df = spark.createDataFrame(
        rows,
        "catchment_id string, flood_risk_score double, flood_risk_level string, drought_risk_score double, drought_risk_level string, basin string",
    )
    counts = {(r["risk_type"], r["level"]): r["n_catchments"] for r in risk.risk_distribution(df).collect()}
    assert counts == {("flood", "Low"): 2, ("flood", "High"): 1, ("drought", "High"): 1, ("drought", "Low"): 2}
    basin = risk.risk_by_basin(df).head()
    assert (basin["n_catchments"], basin["mean_flood_risk"]) == (2, 0.3)
    assert [r["catchment_id"] for r in risk.rank_risk(df).collect()] == ["b", "c", "a"]


def test_conformal_rank(spark):
    rows = [(0.0, 1.0, 1.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "lo double, hi double, y_true double")
    got = intervals.conformal_calibrate(df).head()
    assert (got["n"], got["k"], got["q"]) == (20, 19, 18.0)


def test_interval_is_widened_ordered_and_clamped(spark):
    df = spark.createDataFrame([(5.0, 1.0, 2.0), (0.5, 1.0, 2.0), (None, None, None)], "lo double, med double, hi double")
    q = spark.createDataFrame([(1.0,)], "q double")
    rows = [tuple(r) for r in intervals.predict_interval(df, q).collect()]
    assert sorted(rows[:2]) == [(0.0, 1.0, 3.0), (1.0, 3.0, 4.0)]
    assert rows[2] == (None, None, None)


def test_interval_quality(spark):
    df = spark.createDataFrame([(0.0, 2.0, 2.0), (0.0, 2.0, 3.0)], "lo double, hi double, y_true double")
    got = intervals.interval_quality(df).head()
    assert got["picp_observed_coverage"] == 0.5
    assert got["mpiw_mean_interval_width"] == 2.0
    assert got["coverage_error"] == -0.4


def test_best_model_keeps_the_earlier_of_equal_scores(spark):
    rows = [("a", 0, 0.5), ("b", 1, 0.7), ("c", 2, 0.7), ("failed", 3, None)]
    df = spark.createDataFrame(rows, "model string, place int, score double")
    assert compare.pick_best_model(df).head()["model"] == "b"
    assert [r["model"] for r in compare.rank_models(df, "score").collect()] == ["b", "c", "a", "failed"]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "streamflow_mm_day double")
    rows = profiles.histogram(df, bins=4).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(2, 2)]


def test_correlation_without_common_rows_is_null(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, 4.0, 5.0)], "a double, b double, c double")
    rows = {(r["column_a"], r["column_b"]): r["correlation"] for r in profiles.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(rows) == 9
    assert rows[("a", "a")] == pytest.approx(1.0)
    assert rows[("a", "b")] is None
    assert rows[("a", "c")] is None
