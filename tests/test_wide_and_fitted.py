"""Wide matrices, grouped folds, files that differ in columns, the whole preparation, and ranks on two levels."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from daypanel.modelling import explain, quantile_regression, search, validation
from daypanel.operators import fitted, intervals, order, profiles
from daypanel.operators.frames import Frame
from daypanel.sources import readers


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def correlations(df, names):
    return {(r["column_a"], r["column_b"]): r["correlation"] for r in profiles.correlation_matrix(df, names).collect()}


def test_correlation_of_columns_with_gaps_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e7
    x[:, 3], x[:, 4] = 0.1, -x[:, 0]
    gaps = rng.random(x.shape) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(r, w, strict=True)) for r, w in zip(x, gaps, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, minus double").repartition(7)
    found = correlations(df, df.columns)
    assert len(found) == 25
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns):
            both = ~gaps[:, i] & ~gaps[:, j]
            if "flat" in (a, b):
                assert found[a, b] is None
            else:
                assert found[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_correlation_of_many_columns_is_one_scan(spark):
    names = [f"x{i}" for i in range(141)]
    df = spark.range(2_000).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    result = profiles.correlation_matrix(df, names)
    assert result._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert result.count() == 141 * 141
    empty = profiles.correlation_matrix(df.limit(0), names[:2])
    assert empty.collect() == []


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{e}", i, *map(float, rng.normal(size=2)), float(e)) for e in range(12) for i in range(40)]
    rows += [("short", i, 0.0, 0.0, 1.0) for i in range(5)] + [(None, 1, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "catchment_id string, i int, x1 double, x2 double, e double")
    target = F.greatest(F.lit(0.0), 30 + 2 * F.col("x1") - F.col("x2") + 0.1 * F.col("e"))
    df = df.withColumn("streamflow_mm_day", target).selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", "x1", "x2", "streamflow_mm_day")
    return df.cache()


def test_grouped_folds_score_every_large_entity_once(groups):
    found = validation.grouped_folds(groups, lambda: LinearRegression(), ["x1", "x2"], folds=4).collect()
    assert sorted(r["held_out"] for r in found) == sorted(f"e{e}" for e in range(12))
    assert all(r["n_test"] == 40 and r["nse"] > 0.9 for r in found)
    again = validation.grouped_folds(groups.repartition(9), lambda: LinearRegression(), ["x1", "x2"], folds=4)
    assert {(r["held_out"], r["nse"]) for r in again.collect()} == {(r["held_out"], r["nse"]) for r in found}


def test_a_fold_is_predicted_by_the_others(groups, spark):
    apart = groups.withColumn("streamflow_mm_day", F.when(F.col("catchment_id") == "e3", 500.0).otherwise(1.0))
    found = {r["held_out"]: r["rmse"] for r in validation.grouped_folds(apart, lambda: LinearRegression(), ["x1"], folds=6).collect()}
    assert found["e3"] == pytest.approx(499, abs=1)


def test_matrices_of_entities_are_handed_on_in_parts(groups, monkeypatch):
    whole = {r["held_out"]: r["nse"] for r in validation.leave_one_out_linear(groups, ["x1", "x2"]).collect()}
    batches = groups.where("catchment_id IS NOT NULL").select("catchment_id", "x1", "x2", "streamflow_mm_day").toArrow().to_batches(max_chunksize=50)
    one = list(validation._gram_sums(iter(batches)))
    monkeypatch.setattr(validation, "HELD_NUMBERS", 40)
    many = list(validation._gram_sums(iter(batches)))
    assert len(one) == 1 and len(many) > 3

    def added(parts):
        out = {}
        for b in parts:
            for key, n, sums in zip(*(b.column(c).to_pylist() for c in ("key", "n", "sums")), strict=True):
                m, before = out.get(key, (0, 0.0))
                out[key] = m + n, before + np.array(sums)
        return out

    a, b = added(one), added(many)
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)
    assert sorted(whole) == sorted(f"e{e}" for e in range(12))


def test_importance_of_a_line_is_its_squared_slope_times_the_mean_squared_shift(groups):
    rows = groups.dropna()
    model = search.model_stages(LinearRegression(), ["x1", "x2"]).fit(rows)
    result = explain.permutation_importance(rows, model, ["x1", "x2"])
    found = {r["feature"]: r["importance"] for r in result.collect()}
    ranked = order.hashed_rank(rows, ["catchment_id", "date"], 42).orderBy("rank0").toPandas()
    n = len(ranked)
    shift = 1 + rows.limit(1).select(F.pmod(F.xxhash64(F.lit(42)), F.lit(n - 1))).first()[0]
    for c, slope in zip(("x1", "x2"), model.stages[-1].coefficients, strict=True):
        moved = np.roll(ranked[c].to_numpy(), -shift)
        assert found[c] == pytest.approx(slope**2 * ((ranked[c] - moved) ** 2).mean(), rel=1e-9)
    assert shuffles(result) <= 3


def test_grid_of_few_values_is_those_values(spark):
    df = spark.range(300).selectExpr("CAST(id % 7 AS double) AS few", "CAST(id AS double) AS many", "CAST(NULL AS double) AS none")
    grids = explain.feature_grids(df, ["few", "many", "none"], points=20)
    assert grids["few"] == [float(i) for i in range(7)] and len(grids["many"]) == 20 and "none" not in grids


def test_rank_on_two_levels_is_a_permutation(spark):
    df = spark.range(5_000).withColumn("k", F.col("id") % 1_000)
    wanted = {(r["id"], r["rank0"]) for r in order.hashed_rank(df, ["id"]).collect()}
    assert sorted(r for _, r in wanted) == list(range(5_000))
    for bits in ((1, 1), (2, 6), (10, 0)):  # few coarse parts: the fine ones do the work, or the order inside them
        got = order.hashed_rank(df.repartition(5), ["id"], coarse_bits=bits[0], fine_bits=bits[1]).collect()
        assert {(r["id"], r["rank0"]) for r in got} == wanted and {r["n_rows"] for r in got} == {5_000}


def test_quantiles_by_regression_share_their_passes(groups):
    models = quantile_regression.fit_quantiles(groups, ["x1", "x2"], {"lo": 0.1, "hi": 0.9})
    predicted = quantile_regression.predict_quantiles(groups.where("catchment_id <> 'short'"), models)
    share = predicted.agg(*[F.avg((F.col("streamflow_mm_day") <= F.col(c)).cast("double")) for c in ("lo", "hi")]).first()
    assert 0.05 <= share[0] <= 0.16 and 0.84 <= share[1] <= 0.95
    nothing = quantile_regression.fit_quantiles(groups.limit(0), ["x1"], {"med": 0.5})
    assert nothing["med"].coefficients == (0.0,)


def write(folder, name, text):
    (folder / name).write_text(text)


def test_series_files_that_differ_in_columns(spark, tmp_path):
    write(tmp_path, "00001.csv", "year,month,day,prcp(mm/day),tmax(C)\n2001,1,2,1.5,30\n2001,1,3,,31\n")
    write(tmp_path, "00002.csv", "day,month,year,PRCP(mm/day),note\n5,6,2002,2.5,x\n")
    write(tmp_path, "00003.csv", "prcp(mm/day)\n9\n")
    write(tmp_path, "00004.csv", "")
    (tmp_path / "more").mkdir()
    write(tmp_path / "more", "a b 00005.csv", "year,month,day,prcp(mm/day),tmax(C)\n2003,2,30,7,8\n2003,2,28,7,8\n")
    assert sorted(map(len, readers.header_catalogue(spark, str(tmp_path)).values())) == [1, 1, 2]
    found = readers.read_entity_series(spark, str(tmp_path))
    rows = {(r["catchment_id"], str(r["date"]), r["precipitation_mm"], r["temperature_max_c"]) for r in found.collect()}
    assert rows == {
        ("1", "2001-01-02", 1.5, 30.0), ("1", "2001-01-03", None, 31.0), ("2", "2002-06-05", 2.5, None),
        ("5", "None", 7.0, 8.0), ("5", "2003-02-28", 7.0, 8.0),
    }


def test_panel_from_files(spark, tmp_path):
    (tmp_path / "forcings").mkdir()
    write(tmp_path, "topo.csv", "gauge_id,cwc_area,cwc_lat\n1,86.4,10\n2,,11\n")
    write(tmp_path, "name.csv", "gauge_id,river_basin\n1,A\n3,B\n")
    write(tmp_path, "flow.csv", "year,month,day,00001,00002\n2001,1,2,1.0,5\n2001,1,9,3.0,5\n")
    write(tmp_path / "forcings", "00001.csv", "year,month,day,prcp(mm/day)\n2001,1,2,1.5\n2001,1,3,2.5\n")
    write(tmp_path / "forcings", "00002.csv", "year,month,day,tmax(C)\n2001,1,2,30\n")
    paths = [str(tmp_path / "topo.csv"), str(tmp_path / "name.csv")]
    found = readers.read_panel(spark, paths, str(tmp_path / "forcings"), str(tmp_path / "flow.csv"))
    rows = {(r["catchment_id"], str(r["date"]), r["streamflow_mm_day"], r["precipitation_mm"], r["basin"]) for r in found.collect()}
    assert rows == {("1", "2001-01-02", 1.0, 1.5, "A"), ("1", "2001-01-03", None, 2.5, "A"), ("2", "2001-01-02", None, None, None)}


def test_preparation_without_dates_and_with_copies_of_extremes(spark):
    df = spark.range(1_000).selectExpr(
        "id % 10 AS catchment_id", "date_add(DATE'2000-01-01', CAST(id DIV 10 AS INT)) AS date",
        "CASE WHEN id % 7 > 0 THEN CAST(id AS double) END AS x", "CAST(id % 97 AS double) AS streamflow_mm_day",
    )
    ready = fitted.preprocess(df)
    assert (ready.train.count(), ready.test.count()) == (800, 200)
    assert ready.train.agg(F.max("date")).first()[0] <= ready.test.agg(F.min("date")).first()[0]
    assert ready.features == ["x"] and ready.train.where("x IS NULL").count() == 0
    plain = fitted.preprocess(df, materialize=False)
    close = lambda df: df.withColumn("x", F.round("x", 9))  # noqa: E731  sums in another order differ in their last digits
    assert close(plain.train).exceptAll(close(ready.train)).count() == 0 and close(plain.test).exceptAll(close(ready.test)).count() == 0
    grown = fitted.preprocess(df, oversample_share=0.5)
    assert grown.test.columns == ready.test.columns and grown.params.count() == ready.params.count() == 1
    original = grown.train.where("NOT is_synthetic").drop("is_synthetic")
    assert close(original).exceptAll(close(ready.train)).count() == 0
    extremes = ready.train.where("streamflow_mm_day >= 92 OR streamflow_mm_day <= 4").count()
    assert abs(grown.train.where("is_synthetic").count() - extremes / 2) <= 20


def test_borders_as_numbers_and_as_a_row(spark):
    df = spark.range(100).selectExpr("date_add(DATE'2000-01-01', CAST(id AS INT)) AS date", "CASE WHEN id % 9 > 0 THEN CAST(id AS double) END AS y_pred")
    numbers = intervals.condition_columns(df, "y_pred", intervals.lag_cuts(df, "y_pred"))
    row = intervals.condition_columns(df, "y_pred", intervals.lag_cut_row(df, "y_pred"))
    assert row.columns == numbers.columns and row.exceptAll(numbers).count() == 0 and numbers.exceptAll(row).count() == 0


def test_unknown_statistic_is_refused():
    with pytest.raises(ValueError, match="unknown statistic"):
        Frame("v", "mode", 3, "x")


def test_files_of_two_forms_are_scanned_once_and_listed_to_no_reader(spark, tmp_path, monkeypatch):
    write(tmp_path, "00001.csv", "year,month,day,prcp(mm/day),tmax(C)\n2001,1,2,1.5,30\n\n2001,1,3,,31\n2001,1,4\n")
    write(tmp_path, "00002.csv", 'day,"month",x,year,PRCP(mm/day)\n5,6,"a,b",2002,2.5\n')
    write(tmp_path, "00003.csv", "year,month,tmax(C)\n2001,1,9\n")
    write(tmp_path, "00004.csv", "")
    asked = []
    scan = type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, path, *a, **b: asked.append(path) or scan(self, path, *a, **b))
    found = readers.read_entity_series(spark, str(tmp_path))
    assert asked == [str(tmp_path)]
    rows = {(r["catchment_id"], str(r["date"]), r["precipitation_mm"], r["temperature_max_c"]) for r in found.collect()}
    assert rows == {("1", "2001-01-02", 1.5, 30.0), ("1", "2001-01-03", None, 31.0), ("1", "2001-01-04", None, None), ("2", "2002-06-05", 2.5, None)}
    write(tmp_path, "00005.csv", "year,month,day,tmax(C),TMAX(C)\n2001,1,2,1,2\n")
    with pytest.raises(ValueError, match="twice"):
        readers.read_entity_series(spark, str(tmp_path))
