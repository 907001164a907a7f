"""A training corpus from raw documents: quality, near-duplicates, personal data, packing.

Each stage gets all that its predecessor kept, written as Parquet and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import minhash, packing, pii, quality
from sparkloom.llm.queries import tokenizer
from sparkloom.llm.storage import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of these documents."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows are judged one by one, also where several share a doc_id."""
    return minhash.deduplicated(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 1,024 tokens.

    Fewer pieces of text are remembered than by default, and few after a task, as workers serve the other stages too.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), remembered=300_000, kept=50_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii_masking", pii_masking),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
