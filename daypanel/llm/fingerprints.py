"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where the hash has zero bits under a mask. Chunking is normalised: between
``MIN_CHUNK`` and ``NORMAL_CHUNK`` bytes a strict mask is asked, from there to ``MAX_CHUNK`` a loose one, so lengths gather around the normal one and
boundaries move with the text when it shifts. The fingerprint is the set of chunk digests, each with the bytes it stands for; containment of
one text in another is the share of its bytes whose chunks the other has too.

Successors: rows are range-partitioned and sorted by (id, hash of the text), one shuffle of the texts; the first row of every range is
also sent to the end of the range before (a row per range), so each row meets the next one in a stream. An id with more rows than a
range is cut further by the hash of the text, and so are the NULL ids.

Defined cases: NULL text counts as empty; the fingerprint of empty text is empty, its containment is 1 in an empty text and 0 in any other; rows of one id
are ordered by the hash of their text, NULL ids come first, the row after the last is the first; one row follows itself; an empty table gives an
empty one; other columns are left out. Ids may be numbers, dates, times or texts; texts are cut by their first six bytes.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DateType, StringType

from daypanel.llm.common import slices

MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 32, 96, 512
STRICT_BITS, LOOSE_BITS = 8, 5
#: Rows in a range, and ranges at most (their first rows are known to the driver).
RANGE_ROWS, MAX_RANGES = 5_000, 2_000


@cache
def gear() -> np.ndarray:
    """One 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of the numbers of the last 32 bytes, each shifted left by its distance."""
    h = gear()[data]
    for n in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[n:] += h[:-n] << np.uint32(n) if len(h) > n else 0
        h = shifted
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    return _ends_of([data])[0]


def _ends_of(parts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each part; the hash of all parts is computed at once.

    A boundary is never nearer to the start of its text than ``MIN_CHUNK``, which is as wide as the hash, so no hash that is asked sees a
    byte of another text.
    """
    h = _hashes(np.frombuffer(b"".join(parts), np.uint8))
    loose_at = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)
    strict = loose_at[(h[loose_at] >> np.uint32(32 - STRICT_BITS)) == 0].tolist()
    loose = loose_at.tolist()
    result, start = [], 0
    for part in parts:
        end, at, ends = start + len(part), start, []
        while at < end:
            stop = min(at + MAX_CHUNK, end)
            middle = min(at + NORMAL_CHUNK, end)
            i = bisect_left(strict, at + MIN_CHUNK - 1)
            if i < len(strict) and strict[i] < middle:
                stop = strict[i] + 1
            else:
                i = bisect_left(loose, middle)
                if i < len(loose) and loose[i] < stop:
                    stop = loose[i] + 1
            ends.append(stop - start)
            at = stop
        result.append(ends)
        start = end
    return result


def chunk_sets(parts: list[bytes]) -> list[Counter]:
    """For each part the digests of its chunks with the bytes that each stands for."""
    digest, sets = xxhash.xxh3_64_intdigest, []
    for part, ends in zip(parts, _ends_of(parts), strict=True):
        found: Counter = Counter()
        at = 0
        for end in ends:
            found[digest(part[at:end])] += end - at
            at = end
        sets.append(found)
    return sets


def containment(a: Counter, b: Counter) -> float:
    """Share of the bytes of ``a`` whose chunks ``b`` has too."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total


def serialised(chunks: Counter) -> str:
    """``digest:bytes`` of all chunks in the order of the digest."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def parsed(text: str) -> Counter:
    return Counter({int(d, 16): int(n) for d, n in (c.split(":") for c in text.split())})


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _number_of(key: Column, kind: DataType) -> Column:
    """A number that never falls as the id grows; different ids may share one."""
    if isinstance(kind, DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, (StringType, BinaryType)):
        return F.conv(F.rpad(F.substring(F.hex(key), 1, 12), 12, "0"), 16, 10).cast("double")
    return key.cast("double")


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(range, sent, id, h, text)`` sorted so that each row is followed by its successor; ``sent`` ones are copies of a range's first row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": _number_of(F.col("id"), df.schema[id_col].dataType)})
    total, known = rows.agg(F.count(F.lit(1)), F.count("at")).first()
    ranges = max(1, min(MAX_RANGES, known // RANGE_ROWS))
    cuts = rows.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    often = {c: n for c, n in Counter(cuts).items() if n > 1}  # numbers with more rows than a range get one of their own
    splits = [-float("inf"), *(sorted({*cuts, *(math.nextafter(c, math.inf) for c in often)}) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="at", outputCol="bin", handleInvalid="keep").transform(rows)
    cut = cut.withColumn("bin", F.when(F.col("at").isNull(), F.lit(-1)).otherwise(F.col("bin")).cast("int"))
    parts = {splits.index(c): n for c, n in often.items()} | {-1: min(MAX_RANGES, (total - known) // RANGE_ROWS)}
    parts = {b: n for b, n in parts.items() if n > 1}

    def placed(parts: dict[int, int]) -> DataFrame:
        if not parts:
            return cut.withColumn("range", F.col("bin") * (MAX_RANGES + 1))
        table = df.sparkSession.createDataFrame(sorted(parts.items()), "of int, parts int")
        share = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("parts")
        part = F.coalesce(F.least(F.floor(share).cast("int"), F.col("parts") - 1), F.lit(0))
        split = cut.join(F.broadcast(table), F.col("bin") == F.col("of"), "left")
        return split.withColumn("range", F.col("bin") * (MAX_RANGES + 1) + part).drop("of", "parts")

    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("first")
    found = placed(parts).groupBy("bin", "range").agg(first, F.max("id").alias("last")).collect()  # a row for each range
    ids = {}
    for r in found:
        ids.setdefault(r["bin"], set()).update((r["first"]["id"], r["last"]))
    alone = {b: n for b, n in parts.items() if len(ids.get(b, ())) == 1}  # the hash orders the rows of one id only
    heads = {}
    for r in found:
        place = r["range"] if r["bin"] in alone else r["bin"] * (MAX_RANGES + 1)
        heads[place] = min(heads.get(place, r["first"]), r["first"])
    heads = sorted(heads.items())
    where = [(heads[i - 1][0], place, head["id"], head["h"]) for i, (place, head) in enumerate(heads)]
    ranged = placed(alone)
    kind = df.schema[id_col].dataType.simpleString()
    moved = df.sparkSession.createDataFrame(where, f"to int, of int, head_id {kind}, head_h long")
    same = (F.col("range") == F.col("of")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    sent = ranged.join(F.broadcast(moved), same).select(F.col("to").alias("range"), F.lit(True).alias("sent"), "id", "h", "text")
    every = ranged.select("range", F.lit(False).alias("sent"), "id", "h", "text").unionByName(sent.dropDuplicates(["range"]))
    return every.repartition(len(heads) or 1, "range").sortWithinPartitions("range", "sent", F.col("id").asc_nulls_first(), "h")


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, place = None, None  # the row that waits for its successor, and its range
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = None
    for batch in slices(batches):
        kind = batch.schema.field("id").type
        texts = batch.column("text").to_pylist()
        sets = chunk_sets([t.encode() for t in texts])
        ready = []
        for here, sent, key, text, chunks in zip(
            batch.column("range").to_pylist(), batch.column("sent").to_pylist(), batch.column("id").to_pylist(), texts, sets, strict=True
        ):
            if held is not None and here == place:
                ready.append((*held, text, chunks))
            place, held = here, None if sent else (key, text, chunks)
        changed = [edited(own, after) for _, own, _, after, _ in ready]
        rows = []
        for (key, own, chunks, _, after_chunks), new, new_chunks in zip(ready, changed, chunk_sets([c.encode() for c in changed]), strict=True):
            rows.append((
                key, len(own), hashlib.sha256(new.encode()).hexdigest(), serialised(chunks), serialised(new_chunks),
                containment(chunks, new_chunks), containment(chunks, after_chunks),
            ))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprint_with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text (see :func:`edited`), and its containment in the edited and in the next text."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return _in_order(df, id_col, text_col).mapInArrow(_following, schema).withColumnRenamed("id", id_col)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        shown = [serialised(c) for c in chunk_sets([(t or "").encode() for t in batch.column("text").to_pylist()])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shown, pa.string())], ["id", "fingerprint"])


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``fingerprint`` of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sets, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)
