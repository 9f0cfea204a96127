"""From raw documents to packed training sequences: five stages over the whole corpus.

Every stage takes ``(spark, docs, folder)``, works on all that the stage before
it kept, and returns documents with all their columns; the last one returns the
packed pieces. Between stages the rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import mixing, near_copies, packing, quality, secrets
from cohortspark.llm.tables import settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules and the classifier trained on ``labels`` reject go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, folder, "labels")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies stays."""
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs, secrets.train(docs))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources reach their weights: documents are left out or repeated."""
    return mixing.repeated(mixing.mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents become pieces, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("minhash_dedup", minhash_dedup), ("secret_scan", secret_scan),
    ("source_mix", source_mix), ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # a trained classifier, a trained network and seeded hashes decide


def run(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        rows = settled(stage(spark, rows, folder))
    return STAGES[-1][1](spark, rows, folder)
