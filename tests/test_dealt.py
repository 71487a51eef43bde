"""Panels generated from the seen days, and operators on rows that are dealt by entity."""

import random

from pyspark.sql import functions as F

from daypanel.operators import panel as P
from daypanel.operators import series
from daypanel.operators.frames import add_frames, carry_ordered
from daypanel.schema import DATE, ENTITY


def _tables(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, "d")], f"{ENTITY} int, basin string")
    seen = [(1, 3, 1.0), (1, 4, None), (1, 9, 2.0), (2, 1, 5.0), (2, 20, 6.0), (9, 2, 7.0), (None, 2, 8.0), (1, 40, 9.0), (2, None, 3.0)]
    seen = spark.createDataFrame(seen, f"{ENTITY} int, day int, v double").selectExpr(ENTITY, "date_add(DATE'2000-01-01', day - 1) AS date", "v")
    return entities, seen


def test_dense_panel_is_the_left_join(spark):
    entities, seen = _tables(spark)
    want = P.densify(entities, "2000-01-01", "2000-01-20").join(seen, [ENTITY, DATE], "left")
    got = P.dense_panel(entities, seen, "2000-01-01", "2000-01-20")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dense_panel_and_trailing_frames_shuffle_no_generated_row(spark):
    entities, seen = _tables(spark)
    out = series.rolling_sum(P.dense_panel(entities, seen, "2000-01-01", "2000-01-20"), "v", (3,), dealt=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Exchange")  # above every shuffle


def test_dealt_rows_give_the_same(spark, series_of):
    draw = random.Random(5)
    lists = [[None if draw.random() < 0.4 else draw.randrange(50) for _ in range(n)] for n in (1, 40, 90)]
    df = series_of("v", *lists)
    dealt = df.repartition(4, ENTITY)
    both = [
        (series.rolling_stats(df, ["v"], (3, 7)), series.rolling_stats(dealt, ["v"], (3, 7), dealt=True)),
        (series.ffill(df, ["v"]), series.ffill(dealt, ["v"], dealt=True)),
        (series.interpolate_linear(df, ["v"]), series.interpolate_linear(dealt.withColumn("pos", F.datediff(DATE, F.lit("2000-01-01")) + 1), ["v"], dealt=True).drop("pos")),
    ]
    for want, got in both:
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_carried_in_order_over_small_batches(spark, series_of):
    df = series_of("v", [None, 1, None, None, 2, None], [None, None, 3], [None] * 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = add_frames(df.repartition(2, ENTITY), [series.Frame("v", "lag", 1, "w", 1)], [ENTITY], DATE)
        got = {(r[ENTITY], r[DATE].day): (r["v"], r["w"]) for r in carry_ordered(rows, ["v"], ENTITY).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got["0", d] for d in range(1, 7)] == [(None, None), (1, None), (1, 1), (1, None), (2, None), (2, 2)]
    assert [got["1", d][0] for d in range(1, 4)] == [None, None, 3] and {got["2", d][0] for d in range(1, 6)} == {None}


def test_dealt_rows_without_key_or_day_have_no_features(spark, series_of):
    from daypanel.operators.features import FeatureConfig, engineer_features

    df = series_of("streamflow_mm_day", [*range(6)], [*range(5)]).withColumn(ENTITY, F.when(F.col(ENTITY) == "0", F.col(ENTITY)))
    cfg = FeatureConfig(lags=(1, 2), windows=(3,), covariates=(), warmup=2)
    want = engineer_features(df, cfg)
    got = engineer_features(df.repartition(2, ENTITY), cfg, dealt=True)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_wide_files_have_more_columns_than_a_csv_reader_takes(spark, tmp_path):
    from daypanel.sources import readers

    ids = range(1, 21_001)
    (tmp_path / "w.csv").write_text("year,month,day," + ",".join(map(str, ids)) + "\n2000,1,2,5.5" + "," * 20_999 + "7\n")
    wide = readers.read_wide(spark, str(tmp_path / "w.csv"), "v", known=True)
    assert {(r[ENTITY], r["v"], str(r[DATE])) for r in wide.collect()} == {("1", 5.5, "2000-01-02"), ("21000", 7.0, "2000-01-02")}
