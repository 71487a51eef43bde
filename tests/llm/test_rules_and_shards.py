import re
import zlib
from collections import Counter

from check import compare, connect
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401
from pyspark.sql import functions as F

from daypanel.llm import quality, queries, sharding


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_measures(docs, rows, nothing):
    found = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for r in rows:
        m = plain_measures(r[1])
        expected.append((r[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same_rows(found, expected)
    assert quality.quality(nothing).collect() == []


def test_quality_query_equals_sql(spark):
    assert compare(queries.op3_quality(spark, DATA), connect(DATA), queries.SQL["op3_quality"]) is None


def test_quality_stays_in_the_jvm(spark):
    plan = queries.op3_quality(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_can_be_replaced(docs):
    nobody = quality.quality(docs, rules=(quality.Rule("none", "n_words", -2, -1),))
    assert nobody.where("kept").count() == 0
    assert quality.quality(docs).where("kept").count() == sum(r["kept"] for r in quality.quality(docs).collect())


def test_a_filter_measures_each_text_once(docs):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = quality.quality(docs)
    assert plan(found.where("kept")).count("sort_array") == plan(found).count("sort_array") == 2


def test_shards(docs, rows, nothing):
    even, grown = [1.0] * 7, [1.0] * 8
    found = sharding.assign_shards(docs, even, grown).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7) and 0 <= r["shard"] < 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(nothing, even).collect() == []
    few = sharding.assign_shards(docs, even, grown, buckets=2).select("doc_id", "shard", "grown_shard")
    same_rows(few, [(r["doc_id"], r["shard"], r["grown_shard"]) for r in found])


def test_weighted_shards(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    held = {r["shard"]: r["count"] for r in sharding.assign_shards(ids, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert 2 not in held and 2.8 < held[1] / held[0] < 3.2


def test_shard_query(spark):
    found = queries.op4_sharding(spark, DATA)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert "Python" not in found._jdf.queryExecution().toString()
    assert found.where("grown_shard != shard AND grown_shard != 40").count() == 0
