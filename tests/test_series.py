"""Sequence operators: hand cases, and equality of blocked and unblocked evaluation."""

import random

import pandas as pd
import pytest
from conftest import column
from pyspark.sql import Window
from pyspark.sql import functions as F

from daypanel.functions import scalar as S
from daypanel.operators import features, order, series
from daypanel.operators.features import FeatureConfig


def test_interpolation_fills_inside_and_both_ends(series_of):
    df = series_of("v", [None, 1, None, None, 4, None])
    assert column(series.interpolate_linear(df, ["v"]), "v") == [1, 1, 2, 3, 4, 4]


def test_interpolation_of_an_empty_series(series_of):
    assert column(series.interpolate_linear(series_of("v", [None, None]), ["v"]), "v") == [None, None]


def test_rolling_deviation_needs_two_values(series_of):
    got = column(series.rolling_stats(series_of("v", [1, None, 4]), ["v"], [3], ["std"]), "v_roll3_std")
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx(2.121320, abs=1e-6)


def test_rolling_median(series_of):
    got = column(series.rolling_stats(series_of("v", [5, None, 1, 3]), ["v"], [3], ["median", "count"]), "v_roll3_median")
    assert got == [5, 5, 3, 2]


def test_relative_change_from_zero(series_of):
    df = series_of("v", [0, 1, 0, 0, 2])
    out = series.over_series(df, lambda w: [S.bounded_change(F.col("v"), F.lag("v").over(w)).alias("c")], before=1)
    assert column(out, "c") == [None, 10, -1, None, 10]


def test_missing_rain_is_not_a_dry_day(series_of):
    assert column(series.dry_days(series_of("precipitation_mm", [None, 1.0])), "precipitation_mm_dry_days_7") == [0, 0]


def test_longest_run(series_of):
    df = series_of("v", [1, 1, 9, 1, 1, 1, None, 1], [9, 9]).withColumn("limit", F.lit(5.0))
    got = {r["catchment_id"]: r["longest_run"] for r in series.longest_run_below(df, "v", "limit").collect()}
    assert got == {"0": 3, "1": 0}


@pytest.fixture(scope="module")
def long_series(series_of):
    rng = random.Random(7)
    hot = [None if rng.random() < 0.3 else rng.randrange(20) for _ in range(900)]
    return series_of("v", hot, hot[:40], [3.0]).where("day(date) <> 13")


def test_blocks_equal_one_long_window(long_series):
    def build(w):
        return [
            F.lag("v", 30).over(w).alias("lag"),
            F.avg("v").over(w.rowsBetween(-29, 0)).alias("mean"),
            F.max("v").over(w.rowsBetween(-3, 3)).alias("near"),
        ]

    whole = Window.partitionBy("catchment_id").orderBy("date")
    want = long_series.select("*", *build(whole)).toPandas().sort_values(["catchment_id", "date"], ignore_index=True)
    blocked = series.over_series(long_series, build, before=30, after=3, block_rows=64)
    got = blocked.toPandas().sort_values(["catchment_id", "date"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_carried_values_cross_blocks(long_series):
    whole = Window.partitionBy("catchment_id").orderBy("date")
    want = long_series.select(
        "catchment_id",
        "date",
        F.last("v", True).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("back"),
        F.first("v", True).over(whole.rowsBetween(0, Window.unboundedFollowing)).alias("ahead"),
    )
    got = series.known_before(long_series, {"back": F.col("v")}, block_days=50)
    got = series.known_after(got, {"ahead": F.col("v")}, block_days=50).select("catchment_id", "date", "back", "ahead")
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_forward_fill_twice_changes_nothing(long_series):
    once = series.ffill(long_series, ["v"])
    assert once.exceptAll(series.ffill(once, ["v"])).count() == 0


def test_frame_longer_than_a_block_is_refused(long_series):
    with pytest.raises(ValueError, match="longer"):
        series.over_series(long_series, lambda w: [], before=64, block_rows=64)


def test_position_is_row_number(long_series):
    whole = Window.partitionBy("catchment_id").orderBy("date")
    got = order.with_position(long_series).withColumn("rn", F.row_number().over(whole))
    assert got.where("pos <> rn").count() == 0


def test_sequence_windows(series_of):
    df = series_of("v", list(range(25)))
    out = series.sequence_windows(df, ["v"], 5)
    rows = out.orderBy("date").collect()
    assert len(rows) == 21
    assert [x["v"] for x in rows[0]["window"]] == [0, 1, 2, 3, 4]
    assert [r["part"] for r in rows].count("validation") == 2
    filled = df.join(out.select("catchment_id", "date", F.lit(1.5).alias("p")), ["catchment_id", "date"], "left")
    assert column(series.fill_first_prediction(filled, "p"), "p") == [1.5] * 25


def test_features_without_today_do_not_use_the_target_of_the_day(series_of):
    values = [float(i % 17) for i in range(60)]
    changed = values[:-1] + [999.0]
    cfg = FeatureConfig(include_current=False)
    a, b = (
        features.engineer_features(series_of("streamflow_mm_day", v), cfg).drop("streamflow_mm_day") for v in (values, changed)
    )
    assert a.exceptAll(b).count() == 0


def test_warm_up_drops_rows_by_position(series_of):
    df = series_of("streamflow_mm_day", list(range(40)), list(range(31)))
    assert series.drop_warmup(df, 30).count() == 11
    assert features.engineer_features(df).count() == 11


@pytest.mark.parametrize("shift", [0, 1])
def test_staged_frames_equal_long_windows(long_series, shift):
    aggregates = {
        "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum,
        "count": F.count,
    }
    rows = (1, 2, 3, 7, 8, 14, 30)
    df = long_series.withColumn("v", F.col("v") * 1.25 + 1e6)  # far from zero, where plain sums of squares lose digits
    whole = Window.partitionBy("catchment_id").orderBy("date")
    frames = [series.Frame("v", s, n, f"{s}_{n}", shift) for s in (*aggregates, "median") for n in rows]
    plain = [a("v").over(whole.rowsBetween(-(n - 1) - shift, -shift)).alias(f"{s}_{n}") for s, a in aggregates.items() for n in rows]
    want = df.select("*", *plain).toPandas().sort_values(["catchment_id", "date"], ignore_index=True)
    got = series.over_series(df, lambda w: [], frames=frames, block_rows=64)
    got = got.toPandas().sort_values(["catchment_id", "date"], ignore_index=True)
    assert got.columns[:3].tolist() == ["catchment_id", "date", "v"] and len(got) == len(want)
    for s in aggregates:
        for n in rows:
            pd.testing.assert_series_equal(got[f"{s}_{n}"], want[f"{s}_{n}"].astype(float), rtol=1e-9, atol=1e-9)
    for _, group in got.groupby("catchment_id"):
        values = group["v"].shift(shift)
        expected = values.rolling(7, min_periods=1).median()
        pd.testing.assert_series_equal(group["median_7"], expected, check_names=False)


def test_frames_of_rows_below_a_limit(long_series):
    whole = Window.partitionBy("catchment_id").orderBy("date").rowsBetween(-6, 0)
    want = long_series.withColumn("v_dry_days_7", F.sum(F.when(F.col("v") < 5, 1).otherwise(0)).over(whole))
    got = series.dry_days(long_series, "v", 7, 5.0)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
