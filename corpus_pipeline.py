"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of ``documents``.
Defined cases follow the operators: null and empty texts pass the filters that don't reject them, are mixed with size
0 and packed as one closing id; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm import mixing, neardup, packing, quality, secrets
from typeloom.llm.common import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go; it learns from the labels of the documents at hand."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: likeness of 0.8 on shingles of five words."""
    return neardup.kept_rows(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; texts without any stay as they are."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as the mix takes them."""
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every emitted document is packed: a row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Trained, tokenised and hashed stages have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else saved(docs), sf_dir)
    return docs
