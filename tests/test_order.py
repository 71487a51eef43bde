"""Ranks and order statistics, on skewed groups and for different partitionings."""

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from daypanel.operators import order, resample


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine rows of ten in one group; narrow, tiny, tied and negative values."""
    rng = np.random.default_rng(5)
    n = 6000
    values = np.concatenate(
        [rng.normal(1000, 0.01, n // 3), rng.normal(0, 1e-6, n // 3), rng.integers(-3, 4, n - 2 * (n // 3))]
    )
    groups = np.where(rng.random(n) < 0.9, "hot", "cold")
    rows = [(i, str(g), float(v)) for i, (g, v) in enumerate(zip(groups, values, strict=True))]
    return spark.createDataFrame(rows, "id long, g string, v double"), values, groups


def test_quantiles_equal_numpy(skewed):
    df, values, groups = skewed
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for row in order.quantiles(df, "v", probs, ["g"]).collect():
        want = np.quantile(values[groups == row["g"]], list(probs.values()))
        assert [row[n] for n in probs] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-15)


def test_order_statistic_is_exact(skewed):
    df, values, _ = skewed
    got = order.order_statistics(df, "v", {"first": lambda n: F.lit(0), "k": lambda n: F.lit(4321)}).head()
    ordered = np.sort(values)
    assert (got["first"], got["k"], got["n"]) == (ordered[0], ordered[4321], len(values))


def test_quantiles_ignore_missing_values_and_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 9.0)], "g string, v double")
    rows = order.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()
    assert [(r["g"], r["m"]) for r in rows] == [("a", 2.0)]


def test_built_in_and_distributed_quantiles_agree(skewed):
    df, _, _ = skewed
    a = order.quantiles(df, "v", {"x": 0.3, "y": 0.77}, ["g"]).orderBy("g").collect()
    b = order.series_quantiles(df, "v", {"x": 0.3, "y": 0.77}, ["g"]).orderBy("g").collect()
    assert a == b


def panel(spark, days, entities, partitions):
    rows = spark.range(days * entities).selectExpr(
        f"id % {entities} AS catchment_id", f"date_add(DATE'2000-01-01', CAST(id DIV {entities} AS INT)) AS date"
    )
    return rows.repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 7])
def test_global_rank_is_a_date_ordered_permutation(spark, partitions):
    rows = order.global_rank(panel(spark, 40, 30, partitions)).orderBy("rank0").collect()
    assert [r["rank0"] for r in rows] == list(range(1200))
    assert [r["date"] for r in rows] == sorted(r["date"] for r in rows)
    assert {r["n_rows"] for r in rows} == {1200}


def test_ranks_do_not_depend_on_partitioning(spark):
    for f in (order.global_rank, lambda d: order.hashed_rank(d, ["catchment_id", "date"])):
        a, b = f(panel(spark, 20, 30, 1)), f(panel(spark, 20, 30, 9))
        assert a.exceptAll(b).count() == 0


def test_stride_positions(spark):
    df = panel(spark, 10, 1, 2)
    kept = order.stride_sample(df, 4)
    assert [(d - kept.agg(F.min("date")).head()[0]).days for d in column(kept, "date")] == [0, 3, 6, 9]
    assert order.stride_sample(df, 10).count() == 10
    assert order.stride_sample(df, 25).count() == 10


@pytest.mark.parametrize("m", [1, 2, 3, 7, 50, 299])
def test_stride_count_equals_even_steps(spark, m):
    want = len(set(np.linspace(0, 299, m).astype(int)))
    assert order.stride_sample(panel(spark, 100, 3, 3), m).count() == want


def test_folds_cover_the_tail_in_order(spark):
    rows = order.time_series_folds(panel(spark, 11, 1, 2), 3).orderBy("date").collect()
    assert [r["fold"] for r in rows] == [None] * 5 + [0, 0, 1, 1, 2, 2]


def test_sample_is_the_same_for_any_partitioning(spark):
    a = order.sample_rows(panel(spark, 20, 30, 1), 50)
    assert a.count() == 50
    assert a.exceptAll(order.sample_rows(panel(spark, 20, 30, 8), 50)).count() == 0


def test_oversampling_is_repeatable(spark):
    def grown(partitions):
        df = panel(spark, 50, 20, partitions).withColumn("streamflow_mm_day", F.pmod(F.hash("catchment_id", "date"), F.lit(97)).cast("double"))
        return resample.oversample_extremes(df.withColumn("x", F.col("streamflow_mm_day") / 2), ["x"], share=0.5)

    a, b = grown(1), grown(6)
    synthetic = a.where("is_synthetic")
    extremes = resample.extreme_rows(a.where("NOT is_synthetic"), "streamflow_mm_day").count()
    assert synthetic.count() == extremes // 2
    keys = ["catchment_id", "date", "is_synthetic"]
    assert a.select(keys).exceptAll(b.select(keys)).count() == 0
    assert synthetic.where("date IS NULL OR x IS NULL").count() == 0
