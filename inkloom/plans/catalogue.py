"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.plans import alignment_queries, record_queries, relation_queries, sequence_queries, text_queries  # noqa: F401
from inkloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence chunks of the corpus."""
    return text_queries.sentence_chunks(spark, sf_dir)
