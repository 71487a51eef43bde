"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes of the text's shingles. Two fingerprints link at
``MAX_BITS`` = 2 or fewer differing bits. Cut into two halves, one half of a linked pair differs in one bit at most, so the pair
agrees on that half with the same bit left out: every distinct fingerprint is indexed under 64 such one-wildcard variants.

Equal variants meet by equality. A variant shared by exactly two fingerprints gives a candidate pair, which is verified; most variants have one
and vanish after the map-side count. The members of a variant shared by more are joined to it and linked without listing their pairs: two
fingerprints within two bits have a common neighbour within one bit, and all neighbours of one centre are within two bits of each
other, so each member is joined to the smallest member of each of its 65 centres. That is exact and linear in the members.

Components come from alternating star contraction, cut by a table in the shared folder in each round. Copies of a text have
one fingerprint and count as one node, so a group of copies of any size is one row until the last join.

Defined cases: NULL or empty text has fingerprint zero, linked like any other; a NULL id takes part but names no component (NULL only
if no member has an id); rows that repeat are kept; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import slices, texts_of
from daypanel.session import durable

SHINGLE = 3
SEED = 42
MAX_BITS = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of one text, unsigned."""
    words = text.encode().translate(_LOWER).split()  # bytes are split at U+0020 and U+0009 to U+000D
    if not words:
        return 0
    space, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(space(words), seed)]
    else:
        hashes = [digest(space(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(prints)], ["id", "h", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``h`` (hash of the text) and ``fp`` (the fingerprint as a signed long) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"id {kind}, h long, fp long")


def _variants(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under its 64 variants: number of the bit left out, and the half around it without that bit."""
    key = """transform(sequence(0, 63), p -> shiftleft(cast(p AS bigint), 32)
             | (shiftrightunsigned(fp, 32 * (p DIV 32)) & 4294967295L & ~shiftleft(1L, p % 32)))"""
    return nodes.select("fp", F.explode(F.expr(key)).alias("variant"))


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(u, v)``, u < v, over distinct fingerprints ``fp``, whose components are those of all links."""
    variants = _variants(nodes)
    shared = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    shared = durable(shared, "variants")
    pairs = shared.where("n = 2").select("u", "v").distinct().where(f"bit_count(u ^ v) <= {MAX_BITS}")
    # Both sides are dealt by the variant, so a variant of very many fingerprints can be split; the result is read twice.
    several = shared.where("n > 2").select("variant").hint("merge")
    crowded = durable(variants.join(several, "variant", "left_semi").select("fp").distinct(), "crowded")
    centres = crowded.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), p -> fp ^ shiftleft(1L, p)))")).alias("centre")
    )
    smallest = centres.groupBy("centre").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = centres.join(smallest, "centre").where("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every node of ``edges`` (u < v); the root is the smallest node of its component.

    Large star: a node hands its larger neighbours to its smallest one. Small star: a node hands its smaller neighbours to the
    smallest. When nothing changes every node hangs on its root.
    """
    edges = durable(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(low, "v")
        small = hung.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v"))
        edges = durable(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(now) == before:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("root"))
        before = tuple(now)


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``(fp, root)`` of every distinct one."""
    prints = durable(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("id").alias("first"), F.min(_rank()).alias("best")), "nodes")
    roots = components(links(nodes.select("fp")))
    linked = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    return prints, nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _rank():
    """Order in a group: rows with an id first, then by id and hash of the text."""
    return F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Id, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest id reachable) of every row."""
    prints, members = _grouped(df, id_col, text_col, shingle)
    named = members.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = members.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df``, all columns, of one document in each group: the smallest id, then the smallest hash of the text.

    A document is an id with a text; rows that repeat both are the same document and stay together.
    """
    _, members = _grouped(df, id_col, text_col, shingle)
    best = members.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.h")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("rid"), F.xxhash64(F.col(text_col).cast("string")).alias("rh"))
    kept = rows.join(best, F.col("rid").eqNullSafe(F.col("id")) & (F.col("rh") == F.col("h")), "left_semi")
    return kept.select("row.*")
