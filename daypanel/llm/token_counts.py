"""Token counts by a two-tier lookup of pre-token lengths.

First pass, map side: each task counts the space-separated pieces of all its rows in a bounded summary, cuts the frequent ones into
pre-tokens and sends on its most frequent pre-tokens only; the summaries (one row per task) are merged in two rounds. The tokenizer
gives the lengths of the ``table_size`` most frequent, and this table (a few MB, bounded) goes to every task. Second pass, again
map side: a pre-token is looked up in the table, then in the cache of the Python worker; what is in neither is encoded, once for a
slice of text. No pre-token is shuffled. The table decides how fast a text is counted, never the count.

Defined cases: NULL text counts as empty and has 0 tokens; the id may be NULL or repeated, each row is counted; other columns are
left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daypanel.llm.common import slices, texts_of
from daypanel.llm.pretokens import agreed, splitter

#: Pre-tokens in the broadcast table; pieces in the summary of a task; pre-tokens in the cache of a worker.
TABLE_SIZE = 32_768
SUMMARY_SIZE = 65_536
CACHE_SIZE = 131_072
#: Pieces that are encoded in one call.
ENCODED_AT_ONCE = 4_096
#: Summaries merged by one task in the first round, and rows that reach the driver.
MERGED_ROWS = 32


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def encoded_lengths(path: str, pieces: list[str]) -> list[int]:
    encode, found = _tokenizer(path).encode_batch_fast, []
    for i in range(0, len(pieces), ENCODED_AT_ONCE):
        found += [len(e) for e in encode(pieces[i : i + ENCODED_AT_ONCE], add_special_tokens=False)]
    return found


def _halve(counts: Counter, size: int) -> Counter:
    return Counter(dict(counts.most_common(size // 2)))


def _summaries(pattern: str, table_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                pieces.update(text.split(" "))
                if len(pieces) > 2 * SUMMARY_SIZE:
                    pieces = _halve(pieces, 2 * SUMMARY_SIZE)
        split, tokens = splitter(pattern), Counter()
        for piece, n in pieces.most_common(SUMMARY_SIZE // 2):
            for token in split(" " + piece):
                tokens[token] += n
        top = tokens.most_common(table_size)
        if top:
            yield pa.RecordBatch.from_pydict(
                {"token": pa.array([[t for t, _ in top]], pa.list_(pa.string())), "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))}
            )

    return run


def _merge(table_size: int):
    def run(group: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for tokens, n in zip(group.column("token"), group.column("n"), strict=True):
            for t, k in zip(tokens.as_py(), n.as_py(), strict=True):
                counts[t] += k
            if len(counts) > 4 * table_size:
                counts = Counter(dict(counts.most_common(2 * table_size)))
        top = counts.most_common(table_size)
        return pa.table({"token": pa.array([[t for t, _ in top]], pa.list_(pa.string())), "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})

    return run


def frequent_pretokens(df: DataFrame, pattern: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> list[str]:
    """About the most frequent pre-tokens of the whole column, ``table_size`` at most."""
    schema = "token array<string>, n array<long>"
    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_summaries(pattern, table_size), schema)
    rows = rows.withColumn("part", F.spark_partition_id())
    for groups in (MERGED_ROWS * MERGED_ROWS * 4, MERGED_ROWS):
        part = (F.col("part") % groups).cast("int").alias("part")
        merged = rows.select(part, "token", "n").groupBy("part").applyInArrow(_keep_part(_merge(table_size)), "part int, " + schema)
        rows = merged
    counts: Counter = Counter()
    for row in rows.collect():  # one row of bounded length from each of MERGED_ROWS groups
        counts.update(dict(zip(row["token"], row["n"], strict=True)))
    return [t for t, _ in counts.most_common(table_size)]


def _keep_part(merge):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        return merge(group).append_column("part", pa.array([key[0].as_py()], pa.int32())).select(["part", "token", "n"])

    return run


class _Lengths:
    """Lengths of pre-tokens: the given table, and a cache that starts again when it is full."""

    def __init__(self, path: str, table: dict[str, int]):
        self.path, self.table, self.known = path, table, dict(table)

    def add(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > len(self.table) + CACHE_SIZE:
            self.known = dict(self.table)
            new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, encoded_lengths(self.path, new), strict=True))


def _counting(path: str, pattern: str, table: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, split, specials = _Lengths(path, table), splitter(pattern), _specials(path)
        for batch in slices(batches):
            texts = texts_of(batch)
            plain = [agreed(t) and not any(s in t for s in specials) for t in texts]
            cut = [split(t) if p else [] for t, p in zip(texts, plain, strict=True)]
            lengths.add(set().union(*cut))
            get = lengths.known.__getitem__
            counts = [sum(map(get, pieces)) for pieces in cut]
            whole = [i for i, p in enumerate(plain) if not p]
            for i, n in zip(whole, encoded_lengths(path, [texts[i] for i in whole]), strict=True):
                counts[i] = n
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE
) -> DataFrame:
    """Id, ``n_bytes`` and ``n_tokens`` of every row, as the byte-level tokenizer file at ``path`` counts them.

    ``pattern`` is the pre-token pattern of that file. Texts with special strings, or with characters on which Unicode tables
    differ, are encoded whole by the library.
    """
    table = frequent_pretokens(df, pattern, text_col, table_size)
    table = dict(zip(table, encoded_lengths(path, table), strict=True))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counting(path, pattern, table), f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
