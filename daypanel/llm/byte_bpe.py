"""Byte-level BPE over Arrow batches, and its inverse.

A rank file is turned into a tokenizer of the ``tokenizers`` library: every byte becomes one printable character, every way to
join two known tokens into a known token becomes a merge of that token's rank. Texts are split by the pattern; the distinct matches
of a slice that the worker has not met are encoded in one call and kept in a bounded cache, and a text's ids are the joined ids
of its matches. Decoding looks ids up in the reversed byte table and joins bytes, so a character that is split over tokens comes
back whole. Offsets say which characters a token touches.

Defined cases: NULL text counts as empty, has no ids and decodes to no bytes; ids and other columns may be NULL or repeated, each row
is handled; other columns are left out; an empty table gives an empty one. Texts with characters on which Unicode tables differ go
whole through the library that defines the ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from tokenizers import Tokenizer, models, pre_tokenizers

from daypanel.llm.common import slices, texts_of
from daypanel.llm.pretokens import agreed, splitter

#: Matches in the cache of a worker; new ones that are encoded in one call.
CACHE_SIZE = 131_072
LEARNED_AT_ONCE = 4_096


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _library(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _vocabulary(path: str) -> dict[str, int]:
    """Every token in the characters that stand for its bytes."""
    chars = byte_characters()
    return {"".join(chars[b] for b in token): rank for token, rank in _ranks(path).items()}


@cache
def _tokenizer(path: str) -> Tokenizer:
    ranks, chars = _ranks(path), byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


@cache
def _byte_table(path: str) -> list[bytes]:
    """Bytes of every id, read back from the characters of the vocabulary. A worker that only decodes builds no tokenizer."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = _vocabulary(path)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token)
    return table


class Encoder:
    """Text to packed ids (little-endian unsigned 32-bit), one worker's cache included."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self.split, self.known = path, pattern, splitter(pattern), {}

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_SIZE:
            self.known, new = {}, list(pieces)
        encode = _tokenizer(self.path).encode_batch_fast
        for i in range(0, len(new), LEARNED_AT_ONCE):
            some = new[i : i + LEARNED_AT_ONCE]
            for piece, e in zip(some, encode(some, add_special_tokens=False), strict=True):
                self.known[piece] = np.asarray(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) if agreed(t) else None for t in texts]
        self._learn(set().union(*(c for c in cut if c)))
        get = self.known.__getitem__
        whole = lambda t: np.asarray(_library(self.path, self.pattern).encode_ordinary(t), "<u4").tobytes()
        return [whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def decode_ids(path: str, packed: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    table = _byte_table(path)
    return b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def character_spans(path: str, packed: bytes) -> list[tuple[int, int]]:
    """For every token the first character it touches and the one after the last; split characters belong to each of their tokens."""
    table, ids = _byte_table(path), np.frombuffer(packed, "<u4").tolist()
    data = np.frombuffer(b"".join(table[i] for i in ids), np.uint8)
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1  # of every byte
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return [(int(char_at[a]), int(char_at[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)] if ids else []


def _encoding(path: str, pattern: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, pattern)
        for batch in slices(batches):
            packed = encode(texts_of(batch))
            columns = [batch.column("id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            names = ["id", "n_tokens", "ids"]
            if offsets:
                spans = [[{"start": a, "end": b} for a, b in character_spans(path, p)] for p in packed]
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """Id, ``n_tokens`` and packed ``ids`` of every row; ``offsets`` adds the characters that each token touches."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + (", offsets array<struct<start:int,end:int>>" if offsets else "")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoding(path, pattern, offsets), schema).withColumnRenamed("id", id_col)


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            decoded = [decode_ids(path, p or b"") for p in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(decoded, pa.binary()))

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes that the packed ids in ``ids`` stand for (no bytes for NULL)."""
    kept = encoded.drop("decoded")
    schema = StructType([*kept.schema.fields, StructField("decoded", BinaryType())])
    return kept.mapInArrow(_decoding(path), schema)


def packed_ids(ids) -> list[int]:
    """The ids in a packed cell."""
    return np.frombuffer(ids or b"", "<u4").tolist()
