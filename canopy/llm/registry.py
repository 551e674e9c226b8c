"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import hnsw, language, merkle, near_dedup, ngram_lm, oracle, packing, pairwise_quality, periodic, pieces, quality_rules, secrets, sharding, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every row whose id is divisible by 50, against all rows."""
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on sets of 2-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learnt from four fifths of them."""
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of nearly equal bytes."""
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens by the dot-product heuristic."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded merge-dropout segmentations of all documents and whether they decode to the text."""
    return pieces.round_trips(_table(spark, sf_dir, "documents"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base limits and robust outliers by language and source, over all documents."""
    return quality_rules.document_verdicts(_table(spark, sf_dir, "documents"))


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a repeated 50-word window covers."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from preference pairs outside the held-out third."""
    documents = _table(spark, sf_dir, "documents")
    model = pairwise_quality.train_on(documents, _table(spark, sf_dir, "labels"), ~pairwise_quality.held_out())
    return pairwise_quality.score(documents, model)


def op10_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed patterns, and what a conditional random field adds."""
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("redacted")


def op11_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from three quarters of them."""
    return language.document_languages(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents that repeat a period at least three times over 24 words or more."""
    return periodic.document_runs(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots, proofs and verdicts of all documents."""
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw_shards, op2_minhash_forest, op3_log_frequency_bloom, op4_byte_shards, op5_vector_packing, op6_merge_dropout, op7_robust_outliers, op8_difference_cover, op9_pairwise_ranking, op10_crf_secrets, op11_word_backoff, op12_periodic_runs, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE_SQL)
