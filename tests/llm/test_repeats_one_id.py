from pyspark.sql import functions as F

from daypanel.llm import suffix_dedup


def test_texts_of_one_id_with_equal_short_hashes(spark):
    texts = spark.range(400_000).select(F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(5)]).alias("text"))
    pairs = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1")
    a, b = sorted(pairs.selectExpr("sort_array(t) AS t").orderBy("t").first()["t"][:2])
    for key in (1, None):
        df = spark.createDataFrame([(key, a), (key, b), (2, a)], "doc_id long, text string")
        kept = {(r["doc_id"], r["kept_text"]) for r in suffix_dedup.remove_repeats(df).collect()}
        assert kept == {(key, ""), (key, b), (2, "")}
