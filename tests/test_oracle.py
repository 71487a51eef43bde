"""Registered queries against their SQL. ``check.py`` runs all of them; here are the quick ones of every kind."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from conftest import DATA

QUICK = """
read_attributes normalize_id wide_to_long to_geojson_lines rate_to_depth date_from_parts filter_min_history
temporal_split global_rank stride_sample column_profile outer_merge_dims detect_join_key entity_intersection
with_position lag_covariates pct_change_clipped ffill longest_run_below peak_hits baseflow running_best
kge metric_suite_pooled flow_regime_metrics log_nse mid_slope_bias flow_duration_curve_pooled fit_line
benchmark_summary spatial_summary risk_scores rank_models histogram standard_scale time_series_folds oversample_extremes
""".split()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, DATA), con, oracle_sql()[name]) is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
