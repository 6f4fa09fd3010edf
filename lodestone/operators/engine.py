"""Indexing and search over files: documents, vectors and catalogue as versioned tables that outlive the session."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.embed import EmbeddingEngine
from ..sources import files
from ..sources.versioned import VersionedTable
from .hybrid import HybridRetriever
from .keyword_index import KeywordIndex
from .vector_store import VectorStore

DOCS = "id string, source_path string, content string, metadata map<string,string>"
CATALOGUE = "path string, name string, status string, indexed_record_count int, message string"


@dataclass
class RetrievalEngine:
    """Facade: index, remove and search files. parsers goes to sources.files.parse (pdf=, ocr=, docx=)."""

    spark: SparkSession
    path: str
    embedder: EmbeddingEngine = field(default_factory=EmbeddingEngine)
    parsers: dict = field(default_factory=dict)
    chunk_size: int = text.CHUNK_SIZE
    chunk_overlap: int = text.CHUNK_OVERLAP
    vector_weight: float = scoring.VECTOR_WEIGHT
    keyword_weight: float = scoring.KEYWORD_WEIGHT

    def __post_init__(self):
        scoring.check_weights(self.vector_weight, self.keyword_weight)
        self.store = VectorStore(self.spark, f"{self.path}/vectors")
        self.docs = VersionedTable(self.spark, f"{self.path}/docs", DOCS, key="source_path")
        self.catalogue = VersionedTable(self.spark, f"{self.path}/catalogue", CATALOGUE, key="path")
        self.ready = False

    def initialize(self) -> RetrievalEngine:
        self.store.initialize()
        self.docs.create()
        self.catalogue.create()
        self.ready = True
        return self

    def _guard(self) -> None:
        if not self.ready:
            raise RuntimeError("the engine is not initialised")

    # -- indexing ------------------------------------------------------------------------------------------------

    def index_files(self, paths: list[str]) -> DataFrame:
        """Index or replace files; one result row per path, in order: (position, path, is_success, indexed_record_count, message).

        A file's old records go in the same change that brings its new ones; a file that fails keeps what it had.
        """
        self._guard()
        found = files.read_files(self.spark, paths)
        is_image = F.lower(F.col("path")).rlike(r"\.(png|jpg|jpeg|bmp|webp)$")
        texts = files.parse(found.where(F.col("exists") & ~is_image).select("path", "content").dropDuplicates(["path"]), **self.parsers)
        records = self._text_records(texts).unionByName(self._image_records(found.where(F.col("exists") & is_image).dropDuplicates(["path"])))
        records = records.persist()
        try:
            per = records.groupBy("source_path").agg(F.count("*").cast("int").alias("n"), F.min("ok").alias("ok"), F.first("error_message", True).alias("problem"))
            r = found.select("position", "path", "exists").join(per, F.col("path") == per["source_path"], "left").join(texts.select("path", "error_code", "error_message"), "path", "left")
            ok = F.coalesce(F.col("ok"), F.lit(False))
            message = F.when(~F.col("exists"), files.ERR_NOT_FOUND).when(ok, F.lit(None)).otherwise(F.coalesce("problem", "error_message", F.lit("no text")))
            result = r.select("position", "path", ok.alias("is_success"), F.when(ok, F.col("n")).otherwise(0).alias("indexed_record_count"), message.alias("message")).orderBy("position")
            rows = result.collect()  # one row per path that the caller listed
            good = [x["path"] for x in rows if x["is_success"]]
            if good:
                paths = self.spark.createDataFrame([(p,) for p in dict.fromkeys(good)], "source_path string")
                new = records.join(paths, "source_path", "left_semi")
                self.store.replace_source_paths(new.select("id", "source_path", "content", "embedding", "embedding_type", "metadata"))
                texts_only = new.select("id", "source_path", "content", "metadata")
                self.docs.update(lambda old: old.join(paths, "source_path", "left_anti").unionByName(texts_only), lambda _: paths)
            self._note(rows)
            return self.spark.createDataFrame(rows, "position int, path string, is_success boolean, indexed_record_count int, message string")
        finally:
            records.unpersist()

    def index_file(self, path: str) -> DataFrame:
        return self.index_files([path])

    reindex_file = index_file

    def _embedded(self, records: DataFrame, mode: str, space: str) -> DataFrame:
        done = self.embedder.batch(records.select(F.col("id").alias("task_id"), F.lit(mode).alias("mode"), F.col("content").alias("text"), "image"))
        done = done.withColumnRenamed("task_id", "id").withColumnRenamed("vector", "embedding")
        return records.drop("image").join(done, "id").withColumn("embedding_type", F.lit(space))

    def _text_records(self, texts: DataFrame) -> DataFrame:
        chunks = text.chunk_words(F.col("extracted_text"), self.chunk_size, self.chunk_overlap)
        c = texts.where("is_success").select("path", F.size(chunks).alias("count"), F.posexplode(chunks).alias("n", "content"))
        meta = {"data_type": F.lit("text"), "file_name": text.base_name(F.col("path")), "file_extension": _extension(), "chunk_index": F.col("n").cast("string"), "chunk_count": F.col("count").cast("string")}
        c = c.select(text.chunk_id(F.col("path"), F.col("n")).alias("id"), F.col("path").alias("source_path"), "content", _map(meta), F.lit(None).cast("binary").alias("image"))
        return self._embedded(c, "text", "bert")

    def _image_records(self, images: DataFrame) -> DataFrame:
        meta = {"data_type": F.lit("image"), "file_name": text.base_name(F.col("path")), "file_extension": _extension()}
        i = images.select(text.image_id(F.col("path")).alias("id"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("content"), _map(meta), F.col("content").alias("image"))
        return self._embedded(i, "image", "mobileClip")

    def remove_file(self, path: str) -> None:
        self._guard()
        self.store.delete_by_source_path(path)
        for table, column in ((self.docs, "source_path"), (self.catalogue, "path")):
            table.update(lambda old, c=column: old.where(F.col(c) != path), lambda old, c=column: old.where(F.col(c) == path).select(c))

    def _note(self, rows: list) -> None:
        """Catalogue upsert by path."""
        last = {r["path"]: r for r in rows}
        new = self.spark.createDataFrame([(p, p.replace("\\", "/").rsplit("/", 1)[-1], "indexed" if r["is_success"] else "failed", r["indexed_record_count"], r["message"]) for p, r in last.items()], CATALOGUE)
        self.catalogue.update(lambda old: old.join(new, "path", "left_anti").select(*new.columns).unionByName(new), lambda _: new.select("path"))

    def catalogue_status(self) -> DataFrame:
        return self.catalogue.read().groupBy("status").agg(F.count("*").alias("files"), F.sum("indexed_record_count").alias("records"))

    # -- search --------------------------------------------------------------------------------------------------

    def index(self) -> KeywordIndex:
        self._guard()
        return KeywordIndex(self.docs.read())

    def _retriever(self, space: str) -> HybridRetriever:
        vectors = self.store.read().where(F.col("embedding_type") == space).select("id", "embedding")
        return HybridRetriever(self.index(), vectors, self.vector_weight, self.keyword_weight)

    def _query(self, query: str, top_k: int, mode: str) -> tuple[DataFrame, DataFrame]:
        self._guard()
        if not query.strip() or top_k <= 0:
            raise ValueError("a query and a positive top_k are needed")
        queries = self.spark.createDataFrame([("q", query)], "qid string, query string")
        if not queries.select(text.normalize_text(F.col("query"))).first()[0]:
            raise ValueError("the query has no searchable characters")
        done = self.embedder.batch(queries.select(F.col("qid").alias("task_id"), F.lit(mode).alias("mode"), F.col("query").alias("text"), F.lit(None).cast("binary").alias("image")))
        return queries, done.select(F.col("task_id").alias("qid"), F.col("vector").alias("embedding"))

    def search_text(self, query: str, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        r = self._retriever("bert")
        return r.present(r.search(*self._query(query, top_k, "text"), top_k, filters))

    def search_text_documents(self, query: str, top_k: int = 10) -> DataFrame:
        return self.search_text(query, top_k, {"data_type": "text"})

    def search_multimodal(self, query: str, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        r = self._retriever("mobileClip")
        return r.present(r.search(*self._query(query, top_k, "multimodal_text"), top_k, filters))

    def search_images(self, query: str, top_k: int = 10) -> DataFrame:
        return self.search_multimodal(query, top_k, {"data_type": "image"})

    def search_by_image(self, image: bytes, top_k: int = 10, filters: dict | None = None) -> DataFrame:
        """(qid, id, distance, vector_score, rank): nearest records of the image space."""
        self._guard()
        task = self.spark.createDataFrame([("q", "image", None, bytearray(image))], "task_id string, mode string, text string, image binary")
        done = self.embedder.batch(task).select(F.col("task_id").alias("qid"), F.col("vector").alias("embedding"))
        return self.store.search(done, "mobileClip", top_k, filters)

    def text_count(self) -> int:
        return self.store.count("bert")

    def image_count(self) -> int:
        return self.store.count("mobileClip")

    def clear_text(self) -> None:
        self._clear("bert", "text")

    def clear_images(self) -> None:
        self._clear("mobileClip", "image")

    def _clear(self, space: str, data_type: str) -> None:
        self._guard()
        self.store.clear(space)
        self.docs.update(lambda old: old.where(F.try_element_at("metadata", F.lit("data_type")) != data_type))


def _extension():
    return F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))


def _map(values: dict):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("metadata")
