"""A corpus pipeline in five stages, each an operator of evidra.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. Quality rules drop rejected documents, near-duplicates leave one document of each group, secrets
are replaced in the text, sources are mixed by whole passes and sorted in the permuted order, and documents are packed into bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import mixing, near_dup, packing, quality, secret_scan
from evidra.llm.common import Scratch, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, evenness=mixing.EVENNESS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Hash features, sketches, entropy windows and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins. Each stage's table is written, then what the stage itself had stored and the table before it are dropped."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark):
            docs = scratch.store(stage(spark, docs, sf_dir), name)
        scratch.only(docs)
    return docs
