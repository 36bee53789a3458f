"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import contextmix, digestindex, embeddings, hardneg, langid, maintext, mixing, packing, quality, simhash, tokencount, tokenfiles, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Arrow token files and read back."""
    return tokenfiles.token_file_digest(_documents(spark, sf_dir), "word_bpe_49k.json")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mixture(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their near-duplicate components."""
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return contextmix.scored(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_documents(spark, sf_dir), "byte_bpe_50k.json")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality.quality_figures(_documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.languages(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the whole-token shortcut."""
    return tokencount.token_counts(_documents(spark, sf_dir), "byte_bpe_50k.json")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents through the digest index."""
    return digestindex.exact_duplicates(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first four whitened components."""
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors against all vectors."""
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_mixture": op2_mixture,
    "op3_simhash": op3_simhash,
    "op4_lm_scores": op4_lm_scores,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_main_text": op10_main_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_mixture": mixing.SQL,
    "op6_quality_rules": quality.SQL,
    "op11_exact_dedup": digestindex.SQL,
    "op13_hard_negatives": hardneg.SQL,
}
