"""Queries of the text operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _scored(scored: DataFrame, held_out) -> DataFrame:
    out = scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *[c for c in scored.columns if c not in ("doc_id", "score")])
    return out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train_model

    docs, held_out = read(spark, sf_dir, "documents"), lambda i: fold(i, 4) == 2
    return _scored(score_documents(docs, train_model(docs, read(spark, sf_dir, "labels"), held_out)), held_out)


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents, train_model

    docs, held_out = read(spark, sf_dir, "documents"), lambda i: fold(i, 5) == 0
    return _scored(score_documents(docs, train_model(docs, read(spark, sf_dir, "labels"), held_out)), held_out)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import hilbert_shards

    return hilbert_shards(read(spark, sf_dir, "documents"), shards=24)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), PATTERN, spaced=True)


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff import backoff_scores

    return backoff_scores(read(spark, sf_dir, "documents"))


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import rule_measures

    return rule_measures(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality_discriminant, op3_hilbert_shards, op4_byte_bpe, op5_stupid_backoff, op6_fertility_rules, op7_suffix_repeats, op8_weighted_fingerprints, op9_bbit_minhash, op10_power_of_two_packing)
}

#: The ten operators have no SQL here: vocabularies, models and graph closures are outside it, or too slow on whole tables.
ORACLE_SQL: dict[str, str] = {}
