"""Registered queries over the reference operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import retrieval_queries, store_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.Q | retrieval_queries.Q | store_queries.Q
ORACLE_SQL: dict[str, str] = text_queries.S | retrieval_queries.S | store_queries.S


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark items."""
    return retrieval_queries.hybrid_topk(spark, sf_dir)
