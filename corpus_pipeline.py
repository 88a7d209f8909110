"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all rows that the
stage before it kept. The last returns packed pieces. Null texts: the quality rules reject them. Empty tables give
empty tables. Repeated rows are judged alike, and one of them stays after the second stage: of a class of near-duplicates
that with the smallest id, of rows equal in id and text any one. Very long texts go through whole. ``docs`` has the columns
of ``documents`` and keeps them; names that an operator uses itself do no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm import decontam, neardup, packing, quality, secretscan
from cairnlight.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return judged.where("kept").select(*(F.col(f"carry_{c}").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return judged.where("not contaminated").select(*(F.col(f"carry_{c}").alias(c) for c in docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text masked."""
    return secretscan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the decontamination can be said in SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
