"""Queries opN_<name> of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, importance, line_dedup, mixing, packing, pii, quality_rules, simhash, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_mixing": mixing.query,
    "op5_simhash": simhash.query,
    "op6_importance": importance.query,
    "op7_toxicity": toxicity.query,
    "op8_packing": packing.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
