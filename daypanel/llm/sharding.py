"""Rendezvous hashing: each record goes to the shard that draws the best weighted hash for its key.

The key and the list of shards alone decide, so adding a shard moves records only into it. Slots number the records of a shard
without gaps: equal rows are counted before the shuffle and stand in chunks of bounded size from then on, each shard is cut into buckets
by the hash of the chunk, and the buckets' offsets come from a small table of counts, so neither a large shard nor a repeated row meets
in one task.

Defined cases: a NULL key is one key of its own; NULL text has size 16 and the crc32 of no bytes; repeated rows keep the shard of
their key and get neighbouring slots within a chunk; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.common import in_chunks, utf8_size

#: Parts of a shard that are numbered on their own.
BUCKETS = 4096
OVERHEAD = 16


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest ``ln(u) / weight``, ``u`` drawn from md5 of key and shard; equal draws go to the lower shard.

    Equal weights compare the first 60 bits of the hash as they are.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    even = len(set(weights)) == 1

    def draw(shard: int, weight: float) -> Column:
        bits = F.substring(F.md5(F.concat(text, F.lit(f":{shard}")).cast("binary")), 1, 15)
        if even:
            return bits
        u = (F.conv(bits, 16, 10).cast("double") + 1) / F.lit(float(2**60 + 1))
        return F.ln(u) / F.lit(float(weight))

    draws = [F.struct(draw(s, w).alias("draw"), F.lit(-s).alias("back")) for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*draws))["back"]).cast("int")


def assign_shards(
    df: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and the shard after growing to ``grown``, for every row."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("key"),
        (utf8_size(F.col(text_col)) + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = keyed.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.select(
        "*",
        best_shard(F.col("key"), weights).alias("shard"),
        (best_shard(F.col("key"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    spread = F.pmod(F.xxhash64("key", "size", "text_crc32", "chunk"), F.lit(buckets)).cast("int")
    placed = in_chunks(placed, "n").withColumn("bucket", spread)
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "bucket"])
    numbered = first.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slot = F.col("offset") + F.col("ahead") + F.col("rank")
    return numbered.select(
        F.col("key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard"
    )
