"""The operators applied to their whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daypanel.llm import byte_bpe, discriminant, fingerprints, language, mixing, quality, ranked_search, sharding, simhash, spelling, suffix_dedup, token_counts, toxicity
from daypanel.llm.common import fold_of
from daypanel.session import durable

SHARDS = 40
MAX_TOKENS = 1024
HELD_OUT = 2
TOXIC_FROM = 0.3
QUALITY_FOLDS = 5
GOOD_FROM = 0.3
HITS = 50


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.assign_shards(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def toxic_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicModel:
    """Fitted on the labels outside the held-out fold."""
    return toxicity.fit(toxicity.training_rows(docs, labels.where(fold_of(F.col("doc_id")) != HELD_OUT)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxic_model(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return cut.select(
        "doc_id",
        (F.octet_length("kept") + gone).alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_successor(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return digests(byte_bpe.decode(encoded, path))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    sample = language.learn(docs.where(fold_of(F.col("doc_id")) != HELD_OUT))
    predicted = language.predict(docs, sample)
    return predicted.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return ranked_search.ranked_search(docs, items, HITS)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = fold_of(F.col("doc_id"), QUALITY_FOLDS) == 0
    measured = durable(discriminant.measure(docs), "statistics")
    model = discriminant.fit(discriminant.training_rows(measured, labels.where(~held_out)))
    return discriminant.score(measured, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_simhash, op3_quality, op4_sharding, op5_toxicity,
        op6_suffix_dedup, op7_fingerprints, op8_mixing, op9_byte_bpe, op10_language,
        op11_spelling, op12_ranked_search, op13_quality_classifier,
    )
}

SQL: dict[str, str] = {"op3_quality": quality.SQL, "op11_spelling": spelling.SQL, "op12_ranked_search": ranked_search.SQL}
