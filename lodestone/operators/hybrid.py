"""Hybrid retrieval: two top-N branches, min-max normalised, united by a full outer join and fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .keyword_index import KeywordIndex, matches, top
from .vector_store import knn

TOP_K, MULTIPLIER = 10, 5


def united(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Candidates of both branches, by a full outer join, with scores normalised over each branch's own cut list."""
    v = scoring.min_max(vector.select("qid", "id", "vector_score"), "vector_score", ("qid",), "norm_vector")
    k = scoring.min_max(keyword.select("qid", "id", "keyword_score"), "keyword_score", ("qid",), "norm_keyword")
    both = v.join(k, ["qid", "id"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return both.select("qid", "id", zero("vector_score"), zero("norm_vector"), zero("keyword_score"), zero("norm_keyword"), F.col("vector_score").isNotNull().alias("found_by_vector"), F.col("keyword_score").isNotNull().alias("found_by_keyword"))


def ranked(scored: DataFrame, top_k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first top_k of each group by final score, then normalised keyword and vector score, then id."""
    order = Window.partitionBy(*by).orderBy(*[F.round(c, 9).desc() for c in ("final_score", "norm_keyword", "norm_vector")], "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def fuse(vector: DataFrame, keyword: DataFrame, top_k: int, vector_weight: float = scoring.VECTOR_WEIGHT, keyword_weight: float = scoring.KEYWORD_WEIGHT) -> DataFrame:
    """One ranking from vector (qid, id, vector_score) and keyword (qid, id, keyword_score) candidates."""
    scoring.check_weights(vector_weight, keyword_weight)
    final = scoring.fuse_scores(F.col("norm_vector"), F.col("norm_keyword"), vector_weight, keyword_weight)
    return ranked(united(vector, keyword).withColumn("final_score", final), top_k)


@dataclass
class HybridRetriever:
    """Searches over one set of documents: index for words, vectors (id, embedding, and metadata by id) for neighbours.

    Queries are batches: (qid, query) for words, (qid, embedding) for vectors; branches see `multiplier` x top_k
    candidates each. Filters apply before the neighbour search, but after the keyword search has cut its list at
    `multiplier` x the number wanted.
    """

    index: KeywordIndex
    vectors: DataFrame
    vector_weight: float = scoring.VECTOR_WEIGHT
    keyword_weight: float = scoring.KEYWORD_WEIGHT
    multiplier: int = MULTIPLIER

    def __post_init__(self):
        scoring.check_weights(self.vector_weight, self.keyword_weight)
        if self.multiplier <= 0:
            raise ValueError("the candidate multiplier must be positive")

    # -- one branch ----------------------------------------------------------------------------------------------

    def keyword(self, queries: DataFrame, top_k: int = 50, filters: dict | None = None) -> DataFrame:
        """(qid, id, keyword_score, rank). With filters: searched for 5 x top_k, filtered, cut."""
        if not filters:
            return self.index.search(queries, top_k)
        return self.index.filtered(self.index.search(queries, top_k * MULTIPLIER), filters, top_k)

    def keyword_text_documents(self, queries: DataFrame, top_k: int = 50) -> DataFrame:
        return self.keyword(queries, top_k, {"data_type": "text"})

    def keyword_images(self, queries: DataFrame, top_k: int = 50) -> DataFrame:
        return self.keyword(queries, top_k, {"data_type": "image"})

    def by_embedding(self, queries: DataFrame, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        """(qid, id, distance, vector_score, rank)."""
        rows = self.vectors
        if filters:
            rows = rows.join(self.index.docs.where(matches(self.index.docs, filters)).select("id"), "id", "left_semi")
        return knn(rows, queries, top_k)

    # -- both ----------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, embeddings: DataFrame, top_k: int = TOP_K, filters: dict | None = None, keyword_filters: dict | None = None) -> DataFrame:
        """Fused result; keyword_filters replaces filters in the keyword branch where it is given.

        A query without tokens has the vector branch's result alone.
        """
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        n = top_k * self.multiplier
        chosen = filters if keyword_filters is None else keyword_filters
        return fuse(self.by_embedding(embeddings, n, filters), self.keyword(queries, n, chosen), top_k, self.vector_weight, self.keyword_weight)

    def search_text_documents(self, queries: DataFrame, embeddings: DataFrame, top_k: int = TOP_K) -> DataFrame:
        return self.search(queries, embeddings, top_k, {"data_type": "text"})

    def search_images(self, queries: DataFrame, embeddings: DataFrame, top_k: int = TOP_K) -> DataFrame:
        return self.search(queries, embeddings, top_k, {"data_type": "image"})

    def search_multimodal(self, queries: DataFrame, embeddings: DataFrame, top_k: int = TOP_K, filters: dict | None = None) -> DataFrame:
        return self.search(queries, embeddings, top_k, filters)

    def present(self, ranked: DataFrame) -> DataFrame:
        """A ranked result with path, name, snippet, percent and label: documents are fetched for the result only.

        The result's ids, a few for each query, go to the documents, so that texts of others are not shuffled.
        """
        own = {f"__{k}": self.index.field(k) for k in ("file_name", "data_type")}
        d = self.index.docs.withColumns(own).select("id", "source_path", "content", *own)
        r = ranked.join(d.join(F.broadcast(ranked.select("id").distinct()), "id", "left_semi"), "id", "left")
        return r.select(
            *ranked.columns, "source_path",
            text.display_name(F.col("__file_name"), F.col("source_path"), F.col("id")).alias("display_name"),
            text.snippet(F.col("content"), F.col("__data_type")).alias("snippet"),
            text.display_percent(F.col("final_score")).alias("percent"),
            text.match_label(F.col("found_by_vector"), F.col("found_by_keyword")).alias("match_source"),
        )


def get_by_id(index: KeywordIndex, doc_id: str) -> DataFrame:
    """Point lookup as a search result of score 0."""
    return index.get_document(doc_id).select("id", "source_path", "content", F.lit(0.0).alias("keyword_score"))


__all__ = ["HybridRetriever", "fuse", "get_by_id", "top"]
