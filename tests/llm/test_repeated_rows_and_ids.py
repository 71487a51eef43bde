"""Many equal rows, ids of other kinds and ids with many texts; plain loops beside the draws and the chunker."""

import datetime
import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from daypanel.llm import common, fingerprints, mixing, queries, sharding


def test_equal_rows_are_listed_in_chunks(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 4096), ("c", 1), ("d", 4097)], "k string, n long")
    found = common.in_chunks(df, "n").collect()
    assert max(r["n"] for r in found) == common.CHUNK_ROWS and min(r["n"] for r in found) >= 1
    assert {k: sum(r["n"] for r in found if r["k"] == k) for k in "abcd"} == {"a": 10_000, "b": 4096, "c": 1, "d": 4097}
    assert Counter(r["k"] for r in found) == {"a": 3, "b": 1, "c": 1, "d": 2}


def test_slots_of_many_equal_rows(spark):
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rest = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.assign_shards(same.unionByName(rest), [1.0] * 3).groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")
    )
    rows = found.collect()
    assert sum(r["n"] for r in rows) == 30_500 and all((r["n"], r["lo"], r["hi"]) == (r["d"], 0, r["n"] - 1) for r in rows)


def test_mix_of_many_equal_rows(spark):
    same = spark.range(9_000).select(F.lit(7).alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    rest = spark.range(300).select((F.col("id") + 10).cast("int").alias("doc_id"), F.lit("w x y z").alias("text"), F.lit("t").alias("source"))
    found = mixing.mix_rows(same.unionByName(rest))
    assert found.count() == 9_300 and found.where("doc_id = 7").count() == 9_000
    assert found.where("taken > 3 * size").count() == 0


def test_shards_by_a_plain_loop(spark):
    def best(key, n):
        return max(range(n), key=lambda s: (hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:15], -s))

    for r in queries.op4_sharding(spark, DATA).collect():
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 40), best(r["doc_id"], 41))


def test_nearly_all_weight_on_large_shards(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    held = {r["shard"]: r["count"] for r in sharding.assign_shards(ids, [1e18, 3e18]).groupBy("shard").count().collect()}
    assert 2.8 < held[1] / held[0] < 3.2


def plain_ends(data):
    """Byte by byte: the hash of the last 32 bytes, the strict mask until the normal length, the loose one until the longest."""
    table = fingerprints.gear().tolist()
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + table[b]) & 0xFFFFFFFF
        size = i + 1 - start
        bits = fingerprints.STRICT_BITS if size <= fingerprints.NORMAL_CHUNK else fingerprints.LOOSE_BITS
        if (size >= fingerprints.MIN_CHUNK and h >> (32 - bits) == 0) or size == fingerprints.MAX_CHUNK:
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if start < len(data) else [])


def test_chunks_by_a_plain_loop(spark):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rng = np.random.default_rng(2)
    for data in [*texts, bytes(5000), rng.integers(0, 256, 20_000, np.uint8).tobytes(), b"", b"a"]:
        assert fingerprints.chunk_ends(data) == plain_ends(data)


def successors(df, ids):
    """Digest of every row's edited text by hand, rows ordered as the operator states."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, ids(r["doc_id"]), r["h"]))
    edited = [fingerprints.edited(r["text"], rows[(i + 1) % len(rows)]["text"]) for i, r in enumerate(rows)]
    return Counter((r["doc_id"], hashlib.sha256(e.encode()).hexdigest()) for r, e in zip(rows, edited, strict=True))


KINDS = {
    "string": lambda i: f"doc-{i % 90:03d}" if i % 3 else "doc-000",
    "long": lambda i: (1 << 60) + i % 50 if i % 3 else (1 << 60),
    "date": lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(days=i % 90 if i % 3 else 0),
    "int": lambda i: None if i % 3 == 0 else i,
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_successors_of_ids_of_any_kind(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 25)
    rows = [(KINDS[kind](i), None if i == 4 else f"text {i} " * (1 + i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    lowest = {"string": "", "date": datetime.date.min}.get(kind, 0)
    found = fingerprints.fingerprint_with_successor(df)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found.collect()) == successors(df, lambda k: lowest if k is None else k)


def test_rows_of_one_id_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 25)
    for key in (5, None):
        rows = [(key, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(6, 200)]
        df = spark.createDataFrame(rows, "doc_id int, text string")
        held = fingerprints._in_order(df, "doc_id", "text").where("NOT sent").groupBy("range").count()
        assert held.agg(F.max("count")).head()[0] < 120
