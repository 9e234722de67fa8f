"""A corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes what the one before it kept; between two stages the documents are written as
Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from searchspark.llm import jaccard, mixing, packing, pii, quality
from searchspark.plans.staging import stage, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts have the evidence of an empty text;
    repeated rows count each; without labels, all stay; an empty table stays empty."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null last, ties by text. Texts without words
    stay; of repeated rows one stays; an empty table stays empty."""
    return jaccard.deduplicate(docs, jaccard.Rule())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced. Null and empty texts stay as they are, and so do the other columns and the
    number of rows; repeated rows are replaced alike."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Texts without words have nothing to take and go; a null source is
    one of its own; repeated rows count each; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids. Null and empty texts are documents of one id, the end; rows of
    equal ids are packed each; an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """SQL for it, if there is any."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
