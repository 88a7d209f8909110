"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlight.plans import corpus, evaluation, evidence, files, judgement, records, retrieval  # noqa: F401
from cairnlight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.flagship(spark, sf_dir)
