"""Streaming ingestion: new text files or documents are chunked and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators.keyword_index import KeywordIndex
from ..sources.versioned import VersionedTable

CHUNKS = "id string, source_path string, content string, metadata map<string,string>"
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*.txt", per_batch: int = 1000) -> DataFrame:
    """(path, text, modified) of text files as they arrive."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    return read.load(folder).select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def chunked(docs: DataFrame, size: int = text.CHUNK_SIZE, overlap: int = text.CHUNK_OVERLAP) -> DataFrame:
    """(path, text) documents as chunk rows; works on streams and on batches alike."""
    chunks = text.chunk_words(F.col("text"), size, overlap)
    c = docs.select("path", F.size(chunks).alias("count"), F.posexplode(chunks).alias("n", "content"))
    meta = F.create_map(F.lit("data_type"), F.lit("text"), F.lit("file_name"), text.base_name(F.col("path")), F.lit("chunk_index"), F.col("n").cast("string"), F.lit("chunk_count"), F.col("count").cast("string"))
    return c.select(text.chunk_id(F.col("path"), F.col("n")).alias("id"), F.col("path").alias("source_path"), "content", meta.alias("metadata"))


def ingest(docs: DataFrame, table: VersionedTable, checkpoint: str, **chunking) -> StreamingQuery:
    """Upsert a stream of (path, text[, modified]) into table: the chunks of a path replace its former ones.

    Of several texts of one path in a batch the newest by `modified` counts (equal times, or no such column: the
    greatest text). Frequencies are derived at query time, so no state is kept between batches; a batch that is repeated
    after a failure replaces its own rows. A table with source_path as key rewrites the buckets of the batch's paths.
    """
    table.create()
    order = F.struct("modified", "text") if "modified" in docs.columns else F.col("text")

    def upsert(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("text", order).alias("text")).persist()
        try:
            new, paths = chunked(newest, **chunking), newest.select(F.col("path").alias("source_path"))
            table.update(lambda old: old.join(paths, "source_path", "left_anti").select(*new.columns).unionByName(new), lambda _: paths)
        finally:
            newest.unpersist()

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_of(table: VersionedTable) -> KeywordIndex:
    return KeywordIndex(table.read())
