"""Corpus pipeline over the training-data operators: filter, delete repeated lines, drop near copies, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import importance, line_dedup, mixing, packing, simhash
from lodestone.llm.common import scratch, table


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars after a stage that changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the texts labelled good; what it rejects goes."""
    return importance.kept_documents(docs, importance.train(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts; every document stays."""
    return recounted(line_dedup.dedup_lines(docs, count_col=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.distinct_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice comes as two rows."""
    return recounted(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 token ids, one row per piece of a document."""
    return packing.pack(docs, packing.tokenizer_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("source mixing", source_mix),
    ("packing", pack),
]

#: The first stage fits a model and the third and fifth have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
