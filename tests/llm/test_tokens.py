import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import DATA
from llm_cases import docs, nothing, rows, same_rows  # noqa: F401
from tokenizers import Tokenizer

from daypanel.llm import byte_bpe, pretokens, queries, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return byte_bpe._library(RANKS, public_tokenizers.PATTERN)


def test_agreed_characters_split_alike(library):
    split, hf = pretokens.splitter(public_tokenizers.PATTERN), Tokenizer.from_file(JSON).pre_tokenizer
    encode = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    single = re.compile(f"[{pretokens.AGREED}]")
    texts = [f"a {c}b 1{c}{c} x" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]) if single.match(c)]
    assert [t for t in texts if [t[a:b] for _, (a, b) in hf.pre_tokenize_str(t)] != split(t)] == []
    assert [t for t, e in zip(texts, encode(texts), strict=True) if byte_bpe.packed_ids(e) != library.encode_ordinary(t)] == []


def test_token_counts(docs, rows, nothing, spark):
    expected = Tokenizer.from_file(JSON)
    count = lambda t: len(expected.encode(t or "", add_special_tokens=False))
    for size in (4, token_counts.TABLE_SIZE):
        counted = token_counts.count_tokens(docs, JSON, public_tokenizers.PATTERN, table_size=size)
        same_rows(counted, [(r[0], len((r[1] or "").encode()), count(r[1])) for r in rows])
    assert token_counts.count_tokens(nothing, JSON, public_tokenizers.PATTERN).collect() == []
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, DATA).collect():
        assert r["n_tokens"] == count(given[r["doc_id"]]) and r["over_limit"] == (r["n_tokens"] > 1024)


def test_frequent_pretokens_come_first(spark):
    df = spark.createDataFrame([("a b b c c c",)] * 9 + [("zz a",)], "text string").repartition(4)
    top = token_counts.frequent_pretokens(df, public_tokenizers.PATTERN, table_size=3)
    assert set(top) == {" a", " b", " c"}


def test_small_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_SIZE", 3)
    texts = ["the house and the garden", "a b c d e f g", "", "the the", "ab" * 40]
    encode = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in texts * 2:
        assert byte_bpe.packed_ids(encode([t])[0]) == library.encode_ordinary(t)


def test_encode_decode_round_trip(docs, rows, nothing, library):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS)
    expected = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), bytearray(np.asarray(ids, "<u4").tobytes()), bytearray((r[1] or "").encode())))
    same_rows(decoded, expected)
    assert byte_bpe.decode(byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_query_digests(spark, library):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, DATA).collect():
        ids = library.encode_ordinary(given[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(given[r["doc_id"]].encode()).hexdigest()


def test_offsets_cover_split_characters(docs, rows):
    spanned = byte_bpe.encode(docs.where("text IS NOT NULL"), RANKS, public_tokenizers.PATTERN, offsets=True)
    table = byte_bpe._byte_table(RANKS)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in spanned.collect():
        ids = byte_bpe.packed_ids(r["ids"])
        whole = b"".join(table[i] for i in ids).decode()
        assert whole in texts[r["doc_id"]]
        for i, (a, b) in zip(ids, r["offsets"], strict=True):
            assert table[i] in whole[a:b].encode()


@pytest.mark.parametrize("text", ["aaaaaaa", "ababababa", "   \n\n x", "'s's 'll''", "x" * 500, "é" * 99])
def test_merges_with_equal_ranks(text, library):
    assert byte_bpe.packed_ids(byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)([text])[0]) == library.encode_ordinary(text)


def test_decode_is_the_library_s(library):
    ids = library.encode_ordinary("naïve 日本 \U0001f600")
    assert byte_bpe.decode_ids(RANKS, np.asarray(ids, "<u4").tobytes()) == library.decode_bytes(ids)
    assert isinstance(library, tiktoken.Encoding)
