"""Queries over the write path: vector store, engine, file catalogue. Each builds its store in the shared folder.

The store holds the driver's vectors as records of twenty paths; the engine's files are one text file per nation, whose
length grows with its number, an image, a file of an unknown kind and one that is missing.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import functions as F

from ..operators.engine import RetrievalEngine
from ..operators.vector_store import VectorStore
from . import corpus as C
from .retrieval_queries import _knn_sql, _searched, rounded

Q: dict = {}
S: dict = {}


def query(name: str, sql: str):
    def keep(f):
        Q[name], S[name] = f, sql
        return f

    return keep


# -- vector store -------------------------------------------------------------------------------------------------------

STORED = "stored as (select vec_id, vec_id::varchar as id, 'shelf/p' || vec_id % 20 as source_path, 'vector ' || vec_id as content, case when vec_id % 10 = 9 then 'mobileClip' else 'bert' end as embedding_type, 64 as embedding_dimension, label::varchar as label from embeddings)"
COLUMNS = "id, source_path, content, embedding_type, embedding_dimension, label"


def rows(spark, sf):
    v = C.table(spark, sf, "embeddings")
    path = F.concat(F.lit("shelf/p"), (F.col("vec_id") % 20).cast("string"))
    space = F.when(F.col("vec_id") % 10 == 9, "mobileClip").otherwise("bert")
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("source_path"), F.lit("not its path"))
    return v.select(F.col("vec_id").cast("string").alias("id"), path.alias("source_path"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"), "embedding", space.alias("embedding_type"), meta.alias("metadata"))


def number():
    return F.col("id").cast("long")


def store(spark, sf) -> VectorStore:
    """A store with all vectors; opened twice, which must not empty it."""
    s = VectorStore(spark, f"{C.shared_dir(spark)}/lodestone-store-{uuid.uuid4().hex}", {"bert": 64, "mobileClip": 64}).initialize()
    s.add_documents(rows(spark, sf))
    return s.initialize()


def shown(s: VectorStore):
    return s.read().select("id", "source_path", "content", "embedding_type", "embedding_dimension", F.col("metadata")["label"].alias("label"))


@query("store_add", f"with {STORED} select {COLUMNS}, source_path as noted_path from stored")
def _(spark, sf):
    s = store(spark, sf)
    return s.read().select("id", "source_path", "content", "embedding_type", "embedding_dimension", F.col("metadata")["label"].alias("label"), F.col("metadata")["source_path"].alias("noted_path"))


@query("store_upsert", f"with {STORED} select id, case when vec_id % 3 = 0 then 'moved' else source_path end as source_path, case when vec_id % 3 = 0 then 'second' else content end as content, embedding_type, embedding_dimension, label from stored")
def _(spark, sf):
    s = store(spark, sf)
    again = rows(spark, sf).where(number() % 3 == 0).withColumns({"source_path": F.lit("moved"), "content": F.lit("second")})
    s.add_documents(again.unionByName(again))  # rows that come twice are stored once
    return shown(s)


@query("store_delete_document", f"with {STORED} select {COLUMNS} from stored where id <> '7'")
def _(spark, sf):
    s = store(spark, sf)
    s.delete_document("7")
    s.delete_document("no such id")
    return shown(s)


@query("store_delete_by_source_path", f"with {STORED} select {COLUMNS} from stored where source_path <> 'shelf/p3'")
def _(spark, sf):
    s = store(spark, sf)
    s.delete_by_source_path("shelf/p3")
    return shown(s)


@query("store_replace_source_paths", f"with {STORED} select {COLUMNS} from stored where source_path <> 'shelf/p1' or vec_id % 40 = 1")
def _(spark, sf):
    s = store(spark, sf)
    s.replace_source_paths(rows(spark, sf).where(number() % 40 == 1))
    return shown(s)


@query("store_clear", f"with {STORED} select {COLUMNS} from stored where embedding_type <> 'mobileClip'")
def _(spark, sf):
    s = store(spark, sf)
    s.clear("mobileClip")
    return shown(s)


@query("space_count", f"with {STORED} select embedding_type as space, count(*) as n from stored group by 1")
def _(spark, sf):
    s = store(spark, sf)
    return spark.createDataFrame([(space, s.count(space)) for space in s.spaces], "space string, n long")


@query("store_search", _knn_sql("vec_id % 10 <> 9", 10))
def _(spark, sf):
    return rounded(store(spark, sf).search(_searched(spark, sf), "bert", 10), "distance", "vector_score")


@query("store_search_filtered", _knn_sql("vec_id % 20 = 4", 5))
def _(spark, sf):
    return rounded(store(spark, sf).search(_searched(spark, sf), "bert", 5, {"source_path": "shelf/p4"}), "distance", "vector_score")


@query("store_search_images", _knn_sql("vec_id % 10 = 9", 5))
def _(spark, sf):
    return rounded(store(spark, sf).search(_searched(spark, sf), "mobileClip", 5), "distance", "vector_score")


# -- engine -------------------------------------------------------------------------------------------------------------

#: Words and chunks of a nation's file.
NATIONS = "files as (select n_nationkey as k, 'nation_' || n_nationkey || '.txt' as name, greatest(0, ceil((n_nationkey * 10 + 1 - 90) / 70.0))::int + 1 as chunks from nation)"


def png(width: int = 2, height: int = 1) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(range(3 * width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write(spark, folder: str, name: str, data: bytes) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    return f"{folder}/{name}"


def indexed(spark, sf):
    """(engine, folder, result rows): an engine that has indexed all nations' files and the odd ones, in that order."""
    folder = f"{C.shared_dir(spark)}/lodestone-files-{uuid.uuid4().hex}"
    nations = C.table(spark, sf, "nation").orderBy("n_nationkey").collect()  # at most 25
    paths = [write(spark, folder, f"nation_{r.n_nationkey}.txt", " ".join([r.n_name] * (r.n_nationkey * 10 + 1)).encode()) for r in nations]
    paths += [write(spark, folder, "photo.png", png()), write(spark, folder, "thing.xyz", b"?"), f"{folder}/gone.txt"]
    e = RetrievalEngine(spark, f"{folder}-engine").initialize()
    return e, folder, e.index_files(paths)


ODD = "select 25 as position, 'photo.png' as name, true as is_success, 1 as records union all select 26, 'thing.xyz', false, 0 union all select 27, 'gone.txt', false, 0"


@query("engine_index_files", f"with {NATIONS} select k as position, name, true as is_success, chunks as records from files union all {ODD}")
def _(spark, sf):
    _, _, result = indexed(spark, sf)
    return result.select("position", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "is_success", F.col("indexed_record_count").alias("records"))


@query("catalog_status", f"with {NATIONS} select 'indexed' as status, count(*) + 1 as files, sum(chunks)::bigint + 1 as records from files union all select 'failed', 2, 0")
def _(spark, sf):
    return indexed(spark, sf)[0].catalogue_status()


def _kept(e: RetrievalEngine):
    return e.docs.read().groupBy(F.regexp_extract("source_path", "[^/]+$", 0).alias("name")).agg(F.count("*").alias("records"))


@query("engine_remove_and_reindex", f"with {NATIONS} select name, case when k = 20 then 1 else chunks end::bigint as records from files where k <> 12 union all select 'photo.png', 1")
def _(spark, sf):
    e, folder, _ = indexed(spark, sf)
    e.remove_file(f"{folder}/nation_12.txt")
    e.reindex_file(write(spark, folder, "nation_20.txt", b"much shorter now"))
    write(spark, folder, "nation_21.txt", b"\xff\xff")  # no text any more: the file keeps what it had
    e.index_file(f"{folder}/nation_21.txt")
    return _kept(e)


@query("engine_counts", f"with {NATIONS} select 'all' as state, sum(chunks)::bigint as texts, 1::bigint as images from files union all select 'no texts', 0, 1 union all select 'nothing', 0, 0")
def _(spark, sf):
    e, _, _ = indexed(spark, sf)
    found = [("all", e.text_count(), e.image_count())]
    e.clear_text()
    found.append(("no texts", e.text_count(), e.image_count()))
    e.clear_images()
    found.append(("nothing", e.text_count(), e.image_count()))
    return spark.createDataFrame(found, "state string, texts long, images long")


@query("engine_search_text", f"with {NATIONS} select name as display_name, chunks::bigint as n from files where k = 20")
def _(spark, sf):
    e, _, _ = indexed(spark, sf)
    return e.search_text_documents("which chunks name NATION_20", 500).where("keyword_score > 0").groupBy("display_name").agg(F.count("*").alias("n"))


@query("engine_search_by_image", "select 'photo.png' as name, 0.0::double as distance, 1::int as rank")
def _(spark, sf):
    e, _, _ = indexed(spark, sf)
    found = e.search_by_image(png()).join(e.docs.read(), "id")
    return found.select(F.regexp_extract("source_path", "[^/]+$", 0).alias("name"), F.round("distance", 6).alias("distance"), "rank")
