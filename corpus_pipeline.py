"""A corpus pipeline: each stage works on all that the stage before it kept.

Each stage but the last returns the columns it got, in their order; nulls, empty and very
long texts, ties, repeated rows and clashing column names are treated as its operator says,
and an empty table gives an empty one. Quality without labels of both classes keeps all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import common, decontaminate, exact_dedup, packing, quality, queries, simhash
from seqlake.plans import materialise


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return queries.pieces(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("decontamination", clean), ("packing", packed)]

#: Fingerprint components are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table, and what it stored on the way, goes as soon as the next one has been written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{materialise.shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        with materialise.scope(spark):
            stage(spark, docs, sf_dir).write.options(**materialise.PLAIN).parquet(path)
        if before:
            materialise.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
