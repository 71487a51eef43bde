import inspect
from types import SimpleNamespace

from conftest import DATA
from pyspark.sql import functions as F

from daypanel.modelling import explain, search
from daypanel.queries import models


def test_permutation_importance_takes_all_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models.explain, "permutation_importance", lambda df, *a, **b: seen.append(df) or df)
    models.permutation_importance(spark, DATA)
    assert seen[0].count() == models._ready(spark, DATA).test.count() > 2000
    assert explain is models.explain


def test_fit_models_searches_the_whole_spaces(spark, monkeypatch):
    rows = spark.sql("SELECT 'a' AS catchment_id, DATE'2000-01-01' AS date, 1.0D AS streamflow_mm_day, 2.0D AS x1")
    whole, given = inspect.signature(search.fit_models), []

    def searched(*args, **named):
        given.append(whole.bind(*args, **named))
        given[-1].apply_defaults()
        model = SimpleNamespace(transform=lambda df: df.withColumn(search.PREDICTION, F.lit(0.5)))
        return search.Search(rows, "linear", {}, 0.5, model)

    monkeypatch.setattr(models, "_ready", lambda *a: SimpleNamespace(train=rows, test=rows, features=["x1"]))
    monkeypatch.setattr(models.search, "fit_models", searched)
    assert models.fit_models(spark, "nowhere").count() == 1
    used = given[0].arguments
    assert used["spaces"] == search.SEARCH_SPACES and set(used["families"]) == set(search.FAMILIES)
    assert all(used[n] >= whole.parameters[n].default for n in ("folds", "n_trials"))
    assert used["refit"] and used["train"] is rows
