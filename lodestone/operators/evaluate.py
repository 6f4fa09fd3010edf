"""Retrieval quality: recall at k, mean reciprocal rank, weight sweeps, pairwise evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .hybrid import ranked, united

#: (vector weight, keyword weight) settings of a sweep.
SWEEP = ((0.7, 0.3), (0.5, 0.5), (0.4, 0.6), (0.3, 0.7), (0.2, 0.8), (0.1, 0.9))
AT = (1, 5, 10)


def first_relevant(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, rank): rank of each query's first relevant document, null if there is none. truth: (qid, id)."""
    hit = ranked.join(truth, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return truth.select("qid").distinct().join(hit, "qid", "left")


def metrics(ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall at 1, 5 and 10, MRR and number of queries; a missing rank counts as 0."""
    recall = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in AT]
    return ranks.groupBy(*by).agg(F.count("*").alias("n_queries"), *recall, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def weight_sweep(vector: DataFrame, keyword: DataFrame, truth: DataFrame, top_k: int = 10, settings: tuple = SWEEP) -> DataFrame:
    """One row of metrics per weight setting; candidates are found and united once for all settings."""
    for setting in settings:
        scoring.check_weights(*setting)
    weights = F.array(*[F.struct(F.lit(v).alias("vector_weight"), F.lit(k).alias("keyword_weight"), F.lit(v / (v + k)).alias("v"), F.lit(k / (v + k)).alias("k")) for v, k in settings])
    both = united(vector, keyword).withColumn("w", F.explode(weights)).select("*", "w.*")
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") * F.col("norm_vector") + F.col("k") * F.col("norm_keyword")))
    by = ("vector_weight", "keyword_weight", "qid")
    hits = ranked(both.withColumn("final_score", final), top_k, by).join(truth, ["qid", "id"]).groupBy(*by).agg(F.min("rank").alias("rank"))
    asked = truth.select("qid").distinct().withColumn("w", F.explode(weights)).select("qid", "w.vector_weight", "w.keyword_weight")
    return metrics(asked.join(hits, list(by), "left"), ("vector_weight", "keyword_weight"))


def pairwise_ranks(pairs: DataFrame) -> DataFrame:
    """(qid, rank) of candidate i for query i. pairs: (qid, cid, similarity), the relevant one having cid = qid."""
    w = Window.partitionBy("qid").orderBy(F.round("similarity", 9).desc(), "cid")
    return pairs.withColumn("rank", F.row_number().over(w)).where("qid = cid").select("qid", "rank")


def cosine_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(qid, cid, similarity) over equal keys; left: (key, qid, embedding), right: (key, cid, embedding)."""
    r = right.withColumnRenamed("embedding", "__r")
    return left.join(r, "key").select("qid", "cid", scoring.cosine(F.col("embedding"), F.col("__r")).alias("similarity"))
