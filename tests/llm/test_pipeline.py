import hashlib

import corpus_pipeline
from conftest import DATA
from llm_cases import COLUMNS, docs, nothing, rows  # noqa: F401

from daypanel.llm import queries, simhash


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] == seen[2]
    assert simhash.drop_near_duplicates(docs.dropDuplicates()).count() <= seen[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in last.collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_run_is_repeatable(spark):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect())) for _ in range(2))
    assert first == second and first


def test_stages_stand_odd_rows(spark, docs, nothing, tmp_path):
    ids = docs.selectExpr("doc_id", "CAST(text LIKE '%idiot%' AS int) AS toxic")
    ids.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, nothing):
        at = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == given.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == at.count()
    assert COLUMNS.count(",") + 1 == len(docs.columns)


def test_queries_are_registered():
    from __spark_entry__ import queries as registered

    assert set(queries.QUERIES) | {"pipeline"} <= set(registered())
