"""What a line reacts to, from its coefficients."""

import random

from pyspark.sql import functions as F

from daypanel.modelling import explain, search
from daypanel.schema import DATE, ENTITY, TARGET
from test_held_panel import _same


def test_a_line_is_explained_without_a_row_for_each_feature(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, i, draw.random(), draw.random(), draw.random()) for i in range(50)]
    df = spark.createDataFrame(rows, f"{ENTITY} int, day int, a double, b double, {TARGET} double").withColumn(DATE, F.date_add(F.lit("2000-01-01"), F.col("day")))
    model = search.model_stages(search.FAMILIES["linear"]({}), ["a", "b"]).fit(df)
    got = explain.partial_dependence(df, model, ["a", "b"], ["a", "b"], 5), explain.permutation_importance(df, model, ["a", "b"])
    assert "Generate" not in got[1]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(explain, "_line", lambda model: None)
    want = explain.partial_dependence(df, model, ["a", "b"], ["a", "b"], 5), explain.permutation_importance(df, model, ["a", "b"])
    for a, b in zip(got, want, strict=True):
        _same(a, b)
