"""Vector store: a table partitioned by embedding space, exact nearest neighbours by squared distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.versioned import VersionedTable
from .keyword_index import matches, top

#: Width of each embedding space.
SPACES = {"bert": 768, "mobileClip": 512}
#: Queries that one pass over the vectors takes; more come in further passes.
QUERY_BLOCK = 1024


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, distance, vector_score, rank): the k nearest vectors of each query by exact squared L2.

    vectors: (id, embedding), queries: (qid, embedding). Queries are read to the driver in blocks of at most `block`;
    every block is one pass of numpy products over the vectors, and each task sends at most k rows a query to the
    ranking. Ties go by id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = {"qid": dict(rows.dtypes)["qid"], "id": dict(vectors.dtypes)["id"]}
    schema = f"qid {kinds['qid']}, id {kinds['id']}, distance double"
    found = None
    held: list = []

    def scan(held: list) -> DataFrame:
        ids, matrix = [r["qid"] for r in held], np.array([r["embedding"] for r in held], dtype=np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best_d = np.zeros((len(ids), 0))
            best_i = np.zeros((len(ids), 0), dtype=object)
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    x = np.array(part["embedding"].tolist(), dtype=np.float64)
                    d = np.empty((len(ids), len(x)))
                    for q in range(len(ids)):  # differences, not the expanded square: equal vectors are at exactly 0
                        y = x - matrix[q]
                        d[q] = np.einsum("ij,ij->i", y, y)
                    names = np.broadcast_to(part["id"].to_numpy(), d.shape)
                    best_d, best_i = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, names], axis=1)
                    if best_d.shape[1] > k:
                        edge = np.partition(best_d, k - 1, axis=1)[:, k - 1 : k]
                        keep = [np.flatnonzero(best_d[q] <= edge[q]) for q in range(len(ids))]
                        width = max(map(len, keep))
                        if width < best_d.shape[1]:
                            order = np.argsort(best_d, axis=1, kind="stable")[:, :width]
                            best_d, best_i = np.take_along_axis(best_d, order, axis=1), np.take_along_axis(best_i, order, axis=1)
            n = best_d.shape[1]
            for q in range(len(ids)) if n else ():
                yield pd.DataFrame({"qid": [ids[q]] * n, "id": list(best_i[q]), "distance": best_d[q]})

        return vectors.select("id", "embedding").mapInPandas(run, schema)

    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            part = scan(held)
            found, held = part if found is None else found.unionByName(part), []
    if held or found is None:
        if not held:
            return vectors.sparkSession.createDataFrame([], f"{schema}, vector_score double, rank int")
        part = scan(held)
        found = part if found is None else found.unionByName(part)
    # the same rounding as the ranking of scores, so that near-ties order alike everywhere
    ranked = top(found.withColumn("closeness", -F.col("distance")), "closeness", k).drop("closeness")
    return ranked.select("qid", "id", "distance", scoring.distance_score(F.col("distance")).alias("vector_score"), "rank")


SCHEMA = "id string, source_path string, content string, embedding array<float>, metadata map<string,string>, embedding_dimension int, embedding_type string"


@dataclass
class VectorStore:
    """Vectors in a versioned table, a partition per embedding space; every change is seen whole or not at all."""

    spark: SparkSession
    path: str
    spaces: dict[str, int] = field(default_factory=lambda: dict(SPACES))
    #: Parts of a new store; a change rewrites those of the paths that it touches.
    buckets: int = 8

    def __post_init__(self):
        self.table, self.open = VersionedTable(self.spark, self.path, SCHEMA, ("embedding_type",), "source_path", self.buckets), True

    def initialize(self) -> VectorStore:
        """Create an empty store unless there is one; opens a disposed store again."""
        self.table.create()
        self.open = True
        return self

    def read(self) -> DataFrame:
        if not self.open:
            raise RuntimeError("the store is disposed of")
        return self.table.read()

    def _checked(self, docs: DataFrame) -> DataFrame:
        ok = F.lit(False)
        for space, dim in self.spaces.items():
            ok = ok | ((F.col("embedding_type") == space) & scoring.valid_vector(F.col("embedding"), dim))
        named = (F.trim("id") != "") & (F.trim("source_path") != "")
        message = F.concat(F.lit("invalid vector document: "), F.coalesce("id", F.lit("null")))
        checked = docs.withColumn("id", F.when(F.coalesce(ok & named, F.lit(False)), F.col("id")).otherwise(F.raise_error(message).cast("string")))
        own = F.map_from_arrays(F.array(F.lit("source_path"), F.lit("embedding_type"), F.lit("embedding_dimension")), F.array(F.col("source_path"), F.col("embedding_type"), F.size("embedding").cast("string")))
        user = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("source_path", "embedding_type", "embedding_dimension"))
        return checked.select("id", "source_path", "content", "embedding", F.map_concat(user, own).alias("metadata"), F.size("embedding").alias("embedding_dimension"), "embedding_type")

    def _once(self, docs: DataFrame) -> DataFrame:
        """One of the rows that share id and space: the one with the least hash of its values."""
        order = Window.partitionBy("id", "embedding_type").orderBy(F.xxhash64("source_path", "content", "embedding"))
        return self._checked(docs).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")

    def add_documents(self, docs: DataFrame) -> None:
        """Validate all rows, then add them in one change; an invalid row stops it. Rows with an id and space that are
        there replace the old ones; of several such rows in docs one is taken."""
        self.read()
        new = self._once(docs)
        same = ["id", "embedding_type"]
        old_paths = lambda old: old.join(new.select(*same), same, "left_semi").select("source_path")
        self.table.update(lambda old: old.join(new.select(*same), same, "left_anti").unionByName(new), lambda old: old_paths(old).union(new.select("source_path")))

    def delete_document(self, doc_id: str) -> None:
        if not doc_id.strip():
            raise ValueError("an id is needed")
        self.read()
        self.table.update(lambda old: old.where(F.col("id") != doc_id), lambda old: old.where(F.col("id") == doc_id).select("source_path"))

    def delete_by_source_path(self, path: str) -> None:
        if not path.strip():
            raise ValueError("a path is needed")
        self.read()
        self.table.update(lambda old: old.where(F.col("source_path") != path), lambda old: old.where(F.col("source_path") == path).select("source_path"))

    def replace_source_paths(self, docs: DataFrame) -> None:
        """Delete all rows of the paths in docs and add docs, in one change."""
        self.read()
        new = self._once(docs)
        paths = new.select("source_path").distinct()
        self.table.update(lambda old: old.join(paths, "source_path", "left_anti").unionByName(new), lambda _: paths)

    def clear(self, space: str) -> None:
        self._space(space)
        self.read()
        self.table.update(lambda old: old.where(F.col("embedding_type") != space))

    def count(self, space: str) -> int:
        return self.read().where(F.col("embedding_type") == self._space(space)).count()

    def dispose(self) -> None:
        """Give the store up; what it holds stays on disk."""
        self.open = False

    def _space(self, space: str) -> str:
        if space not in self.spaces:
            raise KeyError(f"no such space: {space}")
        return space

    def search(self, queries: DataFrame, space: str, k: int, filters: dict | None = None) -> DataFrame:
        """Nearest neighbours in one space; filters apply before the search."""
        rows = self.read().where(F.col("embedding_type") == self._space(space))
        if filters:
            rows = rows.where(matches(rows, filters))
        return knn(rows, queries, k)
