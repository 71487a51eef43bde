"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, long repeats are cut, sources are mixed
to their weights and the rest is encoded.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Stages see NULLs, empty texts and repeated
rows as their operators define them. No stage but the last can be said in SQL, so there is no SQL for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm import byte_bpe, mixing, simhash, suffix_dedup, toxicity
from daypanel.llm.queries import TOXIC_FROM, toxic_model
from daypanel.session import durable

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labels of the documents it sees, held-out ones left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxic_model(docs, labels), TOXIC_FROM)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked within two bits stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut out of the texts; ``n_chars`` counts what is left, rows stay."""
    cut = suffix_dedup.remove_repeats(docs, others=tuple(docs.columns))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.size("removed") > 0, F.length("kept_text").cast("long"))}
    old = lambda c: F.col(f"row.`{c}`")
    columns = {
        "text": new["text"],
        "n_chars": F.coalesce(new["n_chars"], old("n_chars")) if "n_chars" in docs.columns else None,
    }
    return cut.select(*[(columns[c] if c in columns else old(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, and digests of them and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
