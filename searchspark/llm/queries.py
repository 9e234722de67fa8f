"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from searchspark.llm import (
    jaccard, merkle, mixing, negatives, ogg, packing, periodic, pii, quality, substrings, token_counts, token_files, toxicity,
)
from searchspark.plans.staging import table


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.report(table(spark, sf_dir, "documents"))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own evidence and that of its sites."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an Ogg file and read back."""
    return ogg.media_table(table(spark, sf_dir, "documents"))


def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op5_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that they repeat."""
    return substrings.report(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weights takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike to 85 %."""
    rule = jaccard.Rule(n=4, num=85, den=100)
    return jaccard.cluster(table(spark, sf_dir, "documents"), rule).drop("_component")


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from positive and unlabelled texts."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return token_files.token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed kinds and bootstrapped contexts."""
    return pii.report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which are made periodic first."""
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth vector and its positives."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        f.__name__: f
        for f in (
            op1_merkle_fingerprints, op2_site_quality, op3_ogg_media, op4_cost_packing,
            op5_bucket_pointer_dedup, op6_source_mixing, op7_ngram_jaccard, op8_pu_toxicity, op9_token_files, op10_personal_data,
            op11_periodic_runs, op12_token_counts, op13_hard_negatives,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {
        "op1_merkle_fingerprints": merkle.ORACLE_SQL, "op6_source_mixing": mixing.ORACLE_SQL,
        "op13_hard_negatives": negatives.ORACLE_SQL,
    }
