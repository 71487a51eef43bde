"""The search of model families on few rows."""

import threading

from pyspark.ml.regression import LinearRegression

from daypanel.modelling import search


class Seen(LinearRegression):
    """Waits until four fits have begun, and notes in how many tasks each reads its rows."""

    all_in, lock, tasks = threading.Barrier(4, timeout=90), threading.Lock(), []

    def _fit(self, dataset):
        with Seen.lock:
            Seen.tasks.append(dataset.rdd.getNumPartitions())
            first = len(Seen.tasks) <= 4
        if first:
            Seen.all_in.wait()
        return super()._fit(dataset)


def _panel(spark):
    rows = [(f"{e}", i, float((7 * i + 3 * e) % 11), float(2 * ((7 * i + 3 * e) % 11) + i % 2)) for e in range(4) for i in range(60)]
    made = spark.createDataFrame(rows, "catchment_id string, i int, x1 double, streamflow_mm_day double")
    return made.selectExpr("catchment_id", "date_add(DATE'2000-01-01', i) AS date", "x1", "streamflow_mm_day").repartition(6)


def test_folds_of_all_trials_of_few_rows_are_fitted_side_by_side(spark):
    spaces = {"linear": {"regParam": {"type": "categorical", "choices": [0.0, 0.1]}}}
    found = search.fit_models(
        _panel(spark), ["x1"], folds=2, n_trials=2, families=["linear"], spaces=spaces, factories={"linear": lambda p: Seen(**p)}
    )
    assert Seen.tasks == [1] * 5  # the fifth is the fit to all rows
    trials = found.trials.orderBy("place").collect()
    assert [(t["trial"], len(t["fold_scores"]), t["error"]) for t in trials] == [(0, 2, None), (1, 2, None)]
    assert all(abs(t["score"] - sum(t["fold_scores"]) / 2) < 1e-12 for t in trials) and found.best_score > 0.9


def test_a_trial_that_fails_in_every_fold_has_one_row(spark):
    folded = search.time_series_folds(_panel(spark), 2, whole_days=True)
    good, bad = search.param_search(folded, "linear", ["x1"], 2, [{"regParam": 0.0}, {"regParam": -5.0}], first_place=3)
    assert good[:3] == (3, "linear", 0) and len(good[4]) == 2 and good[5] > 0.9 and good[7] is None
    assert bad[:3] == (4, "linear", 1) and bad[4] is None and bad[5] is None and bad[7]
