"""Text expressions and Arrow helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and Python class of what separates words: space and U+0009 to U+000D.
SEPARATORS = r"[ \t-\r]+"
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20
#: Repeated rows that one row stands for at most when they are listed again.
CHUNK_ROWS = 4096


def words(text: Column) -> Column:
    """The maximal runs of characters that are no separators; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_chunks(df: DataFrame, n: str, chunk: str = "chunk", size: int = CHUNK_ROWS) -> DataFrame:
    """A row that stands for ``n`` rows becomes rows that stand for ``size`` rows at most, numbered from 0."""
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size).cast("long"))
    return df.withColumn(chunk, F.explode(numbers)).withColumn(n, F.least(F.col(n) - F.col(chunk) * size, F.lit(size).cast("long")))


def fold_of(key: Column, folds: int = 4) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; NULL counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
