"""From raw documents to packed training sequences: a corpus in five stages.

Each stage takes what the one before kept, written as Parquet and read again, and its decisions take effect. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from enrichspark.llm import decontaminate, packing, quality, simhash, toxicity
from enrichspark.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours do not vote against them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic window."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose fingerprints of 3-word shingles differ in 3 bits at most."""
    return simhash.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every byte of every document goes in sequences of three lengths."""
    return packing.op3_best_fit_packing(docs)


STAGES = [
    ("quality classifier", good),
    ("toxicity", civil),
    ("simhash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("best-fit packing", packed),
]

# Trained models, xxHash fingerprints and best fit are beyond SQL; tests/llm hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
