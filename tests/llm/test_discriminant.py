import math
import pickle
import random

import numpy as np
import pytest
from conftest import DATA
from llm_cases import docs, nothing, rows  # noqa: F401
from pyspark.sql import functions as F

from daypanel.llm import discriminant, queries


def good_and_bad(n=60):
    rng = random.Random(3)
    words = "the garden of stone and water people house nothing under".split()
    rows = []
    for i in range(n):
        plain = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            plain = [w + rng.choice("***$$$%%%") * 3 for w in plain] if i % 8 else [plain[0]] * 80
        rows.append((i, " ".join(plain), int(i % 4 != 0)))
    return rows


def test_statistics_of_a_text():
    text = "The the THE cat | 12.\nThe the THE cat | 12.\n\n!!"
    found = dict(zip(discriminant.FEATURES, discriminant.statistics(text), strict=True))
    raw = text.split()
    assert found["words"] == pytest.approx(math.log(1 + 13))
    assert found["word_bytes"] == pytest.approx(math.log(sum(map(len, raw)) / 13 + 1))
    assert found["bare_words"] == pytest.approx(math.log(3.5 / 14))
    assert found["repeated"] == pytest.approx(math.log(0.5 / 14))
    assert found["distinct"] == pytest.approx(math.log(8 / 14))
    assert found["capital_heads"] == pytest.approx(math.log(4.5 / 14))
    assert found["distinct_lines"] == pytest.approx(math.log(3 / 4))
    assert found["lines"] == pytest.approx(math.log(3.5 / 14))
    assert discriminant.statistics("a a a")[8] == pytest.approx(math.log(2.5 / 4))
    assert all(map(math.isfinite, discriminant.statistics("")))


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = "Some Words, été 12 $$ \n" * 50
    whole = discriminant.statistics(text)
    monkeypatch.setattr(discriminant, "_PIECE", 13)
    assert discriminant.statistics(text) == whole


def test_fit_equals_the_densities_of_two_gaussians(spark):
    rows = good_and_bad()
    given = spark.createDataFrame(rows, "doc_id int, text string, quality int").repartition(5)
    model = discriminant.fit(discriminant.training_rows(discriminant.measure(given), given))
    x = np.array([discriminant.statistics(r[1]) for r in rows])
    y = np.array([r[2] for r in rows])
    centre, spread = x.mean(0), np.sqrt(np.maximum(x.var(0), discriminant.LEAST))
    z = (x - centre) / spread
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((y == 0).sum() * own[0] + (y == 1).sum() * own[1]) / len(y)
    expected = []
    for k in (0, 1):
        n = (y == k).sum()
        cov = (n * own[k] + discriminant.POOLED * pooled) / (n + discriminant.POOLED)
        cov = (1 - discriminant.RIDGE) * cov + discriminant.RIDGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        gap = z - z[y == k].mean(0)
        expected.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.log_densities(x), np.stack(expected, 1), atol=1e-3)
    score = model.probabilities(x)
    assert score[y == 1].min() > score[y == 0].max()
    assert model.whiteners is model.whiteners and np.array_equal(pickle.loads(pickle.dumps(model)).probabilities(x), score)


def test_one_class_or_none(spark, docs, rows, nothing):
    measured = discriminant.measure(docs)
    for given, share in ((discriminant.measure(nothing), 0.5), (measured, (len(rows) + 1) / (len(rows) + 2))):
        model = discriminant.fit(given.selectExpr("stats", "1 AS label"))
        found = discriminant.score(measured, model)
        assert found.count() == len(rows)
        assert all(r["score"] == pytest.approx(share) for r in found.collect())
    few = discriminant.fit(discriminant.measure(spark.createDataFrame([(1, "good words here"), (0, "%%% $$$")], "label int, text string"), "label"))
    assert all(0 <= r["score"] <= 1 for r in discriminant.score(measured, few).collect())


def test_odd_rows(spark, docs, rows, nothing):
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.lit(1)).when(F.col("doc_id") % 2 == 0, F.lit(0)).alias("quality"))
    measured = discriminant.measure(docs)
    model = discriminant.fit(discriminant.training_rows(measured, labels))
    found = discriminant.score(measured, model)
    assert found.columns == ["doc_id", "score"] and sorted(str(r[0]) for r in found.collect()) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    assert discriminant.score(discriminant.measure(nothing), model).collect() == []


def test_labels_teach_once(spark):
    docs = discriminant.measure(spark.createDataFrame([(1, "a"), (1, "b a"), (2, None), (None, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (2, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    rows = [(round(math.expm1(r["stats"][0])), r["label"]) for r in discriminant.training_rows(docs, labels).collect()]
    assert sorted(rows) == [(0, 0), (1, 1), (2, 1)]


def test_query_on_held_out_labels(spark):
    folder = DATA.replace("0.001", "0.01")
    found = queries.op13_quality_classifier(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 1_000
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    for held_out, least in ((True, 0.95), (False, 0.97)):
        seen = found.where(F.col("held_out") == held_out).join(labels, "doc_id").collect()
        assert sum(r["predicted"] == r["quality"] for r in seen) >= least * len(seen)
