"""Panels held one row an entity: their features, their preparation, and statistics of wide columns."""

import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import fitted, order
from daypanel.operators import panel as P
from daypanel.operators.features import FeatureConfig, engineer_features, held_features
from daypanel.schema import DATE, ENTITY, PRECIP, TARGET

CFG = FeatureConfig(lags=(1, 3), windows=(2, 7), covariates=(PRECIP,), covariate_lags=(1,), sum_windows=(5,), include_current=False, warmup=8)


def _tables(spark, copies=1):
    draw = random.Random(3)
    entities = [(e, "ab"[e % 2], None if e == 3 else float(e)) for e in range(5) for _ in range(copies if e == 2 else 1)]
    seen = [
        (e, d, None if draw.random() < 0.1 else float(draw.randrange(-1, 9)), None if draw.random() < 0.2 else float(draw.randrange(4)))
        for e in range(4) for d in range(60) if draw.random() < 0.6
    ]
    entities = spark.createDataFrame(entities, f"{ENTITY} int, basin string, area_km2 double")
    rows = spark.createDataFrame(seen, f"{ENTITY} int, day int, {TARGET} double, {PRECIP} double")
    return entities, rows.selectExpr(ENTITY, "date_add(DATE'2000-01-01', day) AS date", TARGET, PRECIP)


def _same(got, want):
    shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    assert got.columns == want.columns
    assert sorted(map(str, got.select(shown).collect())) == sorted(map(str, want.select(shown).collect()))


@pytest.mark.parametrize("copies", [1, 3])
def test_features_of_a_held_panel_are_those_of_its_days(spark, copies):
    entities, seen = _tables(spark, copies)
    want = engineer_features(P.dense_panel(entities, seen, "2000-01-01", "2000-02-29"), CFG, dealt=True).drop("pos")
    held = P.hold_panel(entities, seen, "2000-01-01", "2000-02-29")
    _same(held_features(held, CFG), want)
    usable = want.where((F.col(TARGET) >= 0) & F.col(DATE).between(F.lit("2000-01-20").cast("date"), F.lit("2000-02-10").cast("date")))
    _same(held_features(held, CFG, "2000-01-20", "2000-02-10", usable=True), usable)


def test_held_panel_is_prepared_as_its_days_are_and_shuffles_none_of_them(spark):
    entities, seen = _tables(spark)
    days = engineer_features(P.dense_panel(entities, seen, "2000-01-01", "2000-02-29"), CFG, dealt=True).drop("pos", PRECIP)
    want = fitted.preprocess(days, "2000-02-10", "2000-02-11")
    got = fitted.preprocess_held(P.hold_panel(entities, seen, "2000-01-01", "2000-02-29"), CFG, "2000-02-10", "2000-02-11", (PRECIP,))
    assert got.features == want.features and any(r["dropped"] for r in got.params.collect())
    for a, b in ((got.train, want.train), (got.test, want.test), (got.params, want.params)):
        _same(a, b)
    plan = got.test._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("MapInArrow") < plan.find("Exchange")  # above every shuffle


def test_column_quantiles_are_those_of_unfolded_columns(spark):
    draw = random.Random(7)
    rows = [(draw.choice([None, 0.0, -0.0, 1.0, 2.5]), draw.gauss(0, 1e3), float(draw.randrange(-3, 3)), float("nan"), draw.expovariate(1) ** 9) for _ in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    long = df.unpivot([], df.columns, "column", "value")
    probs = {"lo": 0.03, "median": 0.5, "hi": 0.97}
    _same(order.column_quantiles(df, df.columns, probs), order.quantiles(long, "value", probs, ["column"]))


@pytest.mark.parametrize("copies", [1, 3])
def test_a_linear_model_is_applied_where_the_features_are_made(spark, copies, monkeypatch):
    from daypanel.modelling import scoring, search

    entities, seen = _tables(spark, copies)
    held = P.hold_panel(entities, seen, "2000-01-01", "2000-02-29")
    ready = fitted.preprocess_held(held, CFG, "2000-02-10", "2000-02-11", (PRECIP, "precip_intensity", "is_rainy_day"))
    model = search.model_stages(search.FAMILIES["linear"]({"regParam": 0.1}), ready.features).fit(ready.train)
    scored = scoring.score_batch(held, ready.params, model, CFG)
    risk = scoring.score_risk(held, entities.distinct(), ready.params, model, CFG, "2000-01-15")
    for out in (scored, risk):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "UDF(" not in plan
    monkeypatch.setattr(scoring, "_line", lambda m: None)  # rows with all features, scored by the model's own transform
    want, whole = scoring.score_batch(held, ready.params, model, CFG), scoring.score_risk(held, entities.distinct(), ready.params, model, CFG, "2000-01-15")
    assert want.count() == (5 + copies - 1) * 52 and whole.count() == 5
    for got, own in ((scored, want), (risk, whole)):
        # Where a day has several rows, their order is not fixed, and with it the longest run.
        shown = [c for c in own.columns if copies == 1 or not c.startswith(("drought", "combined"))]
        _same(got.select(shown), own.select(shown))


def test_an_input_that_needs_the_value_of_its_day_is_scored_by_the_model(spark):
    from daypanel.modelling import scoring, search

    entities, seen = _tables(spark)
    held = P.hold_panel(entities, seen, "2000-01-01", "2000-02-29")
    ready = fitted.preprocess_held(held, CFG, "2000-02-10", "2000-02-11")
    assert {PRECIP, "is_rainy_day"} & set(ready.features)
    model = search.model_stages(search.FAMILIES["linear"]({"regParam": 0.1}), ready.features).fit(ready.train)
    assert scoring._line_scores(held, ready.params.collect(), model, CFG, None, False) is None
    assert scoring.score_batch(held, ready.params, model, CFG).count() == 5 * 52


def test_scoring_learns_from_a_held_panel_without_its_training_rows(spark, monkeypatch):
    from daypanel.modelling import search

    entities, seen = _tables(spark, 3)
    held = P.hold_panel(entities, seen, "2000-01-01", "2000-02-29")
    unused = (PRECIP, "precip_intensity", "is_rainy_day")
    want = fitted.preprocess_held(held, CFG, "2000-02-10", "2000-02-11", unused, max_missing=0.15)
    written = []
    monkeypatch.setattr(fitted, "durable", lambda df, label: written.append(df.columns) or df.persist())
    got = fitted.learn_held(held, CFG, "2000-02-10", unused, max_missing=0.15)
    assert written == [["column", "_range", "_rows"]]  # counts, no rows
    assert got.features == want.features and any(r["dropped"] for r in got.params.collect())
    _same(got.params, want.params)
    for penalty in ({"regParam": 0.1}, {"regParam": 0.05, "elasticNetParam": 0.5}):
        line = search.FAMILIES["linear"](penalty)
        rows, moments = search.model_stages(line, want.features).fit(want.train), search.fit_moments(spark, got.moments, line, got.features)
        a, b = rows.transform(want.test), moments.transform(want.test)
        _same(b.select(ENTITY, DATE, F.round("prediction", 6)), a.select(ENTITY, DATE, F.round("prediction", 6)))


def test_inputs_that_determine_each_other_are_solved_exactly(spark):
    import numpy as np

    from daypanel.modelling import search

    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 3))
    cells = np.column_stack([x, x[:, 0] + x[:, 1], np.full(200, 2.0), 3 * x[:, 0] - x[:, 2] + draw.normal(size=200)])
    moments = fitted.Moments(200, cells.mean(0), (cells - cells.mean(0)).T @ (cells - cells.mean(0)))
    model = search.fit_moments(spark, moments, search.FAMILIES["linear"]({}), list("abcde"))
    assert model.stages[0].getInputCols() == ["a", "b", "c"]
    inputs = np.column_stack([x, np.ones(200)])
    want = np.linalg.lstsq(inputs, cells[:, -1], rcond=None)[0]
    assert np.allclose([*model.stages[1].coefficients, model.stages[1].intercept], want, rtol=0, atol=1e-10)


def test_inputs_of_their_day_and_no_training_rows_are_left_to_the_rows(spark):
    entities, seen = _tables(spark)
    held = P.hold_panel(entities, seen, "2000-01-01", "2000-02-29")
    assert fitted.learn_held(held, CFG, "2000-02-10") is None
    assert fitted.learn_held(held, CFG, "1999-12-31", (PRECIP, "precip_intensity", "is_rainy_day")) is None


def test_rows_of_the_moments_keep_flat_columns_flat(spark):
    import numpy as np
    import pyarrow as pa

    x = np.arange(10.0)
    parts = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 5]), pa.array([0.1] * 5), pa.array([None, *x[i + 1 : i + 5]])], list("abc")) for i in (0, 5)]
    (row,) = fitted._moments_of([0.0, 0.0, 7.0])(iter(parts))
    cells = np.array([x, np.full(10, 0.1), np.where(x % 5 == 0, 7.0, x)])
    n, means, products = (row.column(i).to_pylist()[0] for i in range(3))
    assert n == 10 and np.allclose(means, cells.mean(1)) and np.allclose(np.reshape(products, (3, 3)) / 10, np.cov(cells, bias=True))
    assert products[4] == 0.0


def test_statistics_of_one_frame_are_put_together_once(monkeypatch):
    import numpy as np

    from daypanel.operators import frames

    joined, calls = frames._joined, []
    monkeypatch.setattr(frames, "_joined", lambda a, b: calls.append(1) or joined(a, b))
    wanted = [frames.Frame("v", s, 7, s) for s in ("mean", "std", "sum")]
    values = np.array([0.0] * 8 + [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0])
    made = frames._cells_of_column(wanted, values, values > 0, None, slice(8, None))
    assert len(calls) == 4  # frames of 2 and 4 rows, and 4 + 2 + 1
    last = values[-7:]
    assert [made[s][0][-1] for s in ("mean", "std", "sum")] == pytest.approx([last.mean(), last.std(ddof=1), last.sum()])
