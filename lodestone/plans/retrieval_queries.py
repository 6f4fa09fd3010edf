"""Queries over keyword, vector and hybrid retrieval, their evaluation and index maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy, scoring, text
from ..operators import evaluate, hybrid
from ..operators.hybrid import HybridRetriever
from ..operators.keyword_index import KeywordIndex, matches
from ..operators.vector_store import knn
from ..sources import files
from . import corpus as C
from .text_queries import CHUNKS, index, written_index

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


def retriever(spark, sf) -> HybridRetriever:
    return HybridRetriever(written_index(spark, sf), C.vectors(spark, sf).select("id", "embedding"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


KW = C.sql_keyword()
TEXT_ONLY = "(select kw.* from kw join records using (id) where data_type = 'text')"

# -- keyword branch -----------------------------------------------------------------------------------------------------


@query("keyword_topk", f"with {KW} select qid, id, round(score, 6) as keyword_score, rank::int as rank from {C.sql_top('kw', 'score', 50)}")
def _(spark, sf):
    return rounded(written_index(spark, sf).search(C.queries(spark, sf), 50), "keyword_score")


def _filtered_sql(where: str, k: int) -> str:
    pool = C.sql_top("kw", "score", 5 * k)
    return f"with {KW}, pool as (select p.qid, p.id, p.score from {pool} p join records using (id) where {where}) select qid, id, round(score, 6) as keyword_score, rank::int as rank from {C.sql_top('pool', 'score', k)}"


@query("keyword_filtered", _filtered_sql("lang = 'en' and file_extension = '.txt'", 20))
def _(spark, sf):
    return rounded(retriever(spark, sf).keyword(C.queries(spark, sf), 20, {"lang": "en", "file_extension": ".txt"}), "keyword_score")


@query("keyword_text_only", _filtered_sql("data_type = 'text'", 50))
def _(spark, sf):
    return rounded(retriever(spark, sf).keyword_text_documents(C.queries(spark, sf)), "keyword_score")


@query("keyword_images", _filtered_sql("data_type = 'image'", 50))
def _(spark, sf):
    return rounded(retriever(spark, sf).keyword_images(C.queries(spark, sf)), "keyword_score")


@query("keyword_frequent_words", f"with {C.sql_keyword('tok in (select tok from hf)', f', hf as (select tok from freq where df / (select count(*) from records) >= 0.3 and not list_contains({C.sql_list(policy.lexicon.NEVER_FILTER)}, tok))')} select qid, id, round(score, 6) as keyword_score, rank::int as rank from {C.sql_top('kw', 'score', 10)}")
def _(spark, sf):
    i = written_index(spark, sf)
    words = policy.FrequentWords(i.high_frequency_words(0.3).select("tok"))
    return rounded(KeywordIndex(i.docs, words, i.folder).search(C.queries(spark, sf), 10), "keyword_score")


@query("metadata_filter", f"with {C.RECORDS} select id from records where data_type = 'text' and lang = 'fr'")
def _(spark, sf):
    d = C.records(spark, sf)
    return d.where(matches(d, {"data_type": "text", "lang": "fr"})).select("id")


@query("metadata_filter_typed", f"with {C.RECORDS} select id, n_chars from records where n_chars = 58")
def _(spark, sf):
    d = C.records(spark, sf)  # the text '58' would match nothing: values compare with their own type
    return d.where(matches(d, {"n_chars": 58}) | matches(d, {"n_chars": "58"})).select("id", "metadata.n_chars")


@query("get_by_id", f"with {C.RECORDS} select id, source_path, content, 0.0::double as keyword_score from records where id = '7'")
def _(spark, sf):
    return hybrid.get_by_id(index(spark, sf), "7")


# -- vector branch ------------------------------------------------------------------------------------------------------

PAIRS = "select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))".format


def _pairs(spark, sf):
    e = C.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query("cosine_pairs", f"select vec_id, round({DOT('x', 'y')} / (sqrt({DOT('x', 'x')}) * sqrt({DOT('y', 'y')})), 6) as cosine from ({PAIRS})")
def _(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("distance_score", f"select vec_id, round(1 / (1 + {DOT('d', 'd')}), 6) as score from (select vec_id, list_transform(list_zip(x, y), lambda z: z[1] - z[2]) as d from ({PAIRS}))")
def _(spark, sf):
    d = scoring.squared_l2(F.col("embedding"), F.col("other"))
    return _pairs(spark, sf).select("vec_id", F.round(scoring.distance_score(d), 6).alias("score"))


@query("l2_normalize", f"select vec_id, list_transform(x, lambda v: round((v / sqrt({DOT('x', 'x')}))::float::double, 4) + 0) as unit from (select vec_id, list_transform(embedding::double[], lambda v: v * 3 + 0.25) as x from embeddings)")
def _(spark, sf):
    moved = F.transform("embedding", lambda v: v.cast("double") * 3 + 0.25)
    unit = F.transform(scoring.l2_normalize(moved), lambda v: F.round(v.cast("double"), 4))
    return C.table(spark, sf, "embeddings").select("vec_id", unit.alias("unit"))


@query("validate_vectors", "select vec_id, len(embedding) = 64 and label % 3 <> 0 as valid from (select vec_id, label, case when label % 3 = 0 then list_append(embedding, 'nan'::float)[2:] else embedding end as embedding from embeddings)")
def _(spark, sf):
    broken = F.when(F.col("label") % 3 == 0, F.slice(F.array_append("embedding", F.lit(float("nan")).cast("float")), 2, 64)).otherwise(F.col("embedding"))
    return C.table(spark, sf, "embeddings").select("vec_id", scoring.valid_vector(broken, 64).alias("valid"))


SEARCHED = "(select vec_id::varchar as qid, embedding::double[] as e from embeddings where vec_id % 50 = 0)"


def _knn_sql(where: str, k: int) -> str:
    d = "list_sum(list_transform(list_zip(e, embedding::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"with n as (select qid, vec_id::varchar as id, {d} as distance from {SEARCHED}, embeddings where {where}), r as (select *, row_number() over (partition by qid order by round(-distance, 9) desc, id) as rank from n) select qid, id, round(distance, 6) as distance, round(1 / (1 + distance), 6) as vector_score, rank::int as rank from r where rank <= {k}"


def _searched(spark, sf):
    return C.vectors(spark, sf).where(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("qid"), "embedding")


@query("knn_l2", _knn_sql("true", 10))
def _(spark, sf):
    return rounded(knn(C.vectors(spark, sf), _searched(spark, sf), 10), "distance", "vector_score")


@query("knn_filtered", _knn_sql("label = 3", 10))
def _(spark, sf):
    return rounded(knn(C.vectors(spark, sf).where("label = 3"), _searched(spark, sf), 10), "distance", "vector_score")


@query("knn_image_space", _knn_sql("vec_id % 10 = 9 and vec_id in (select doc_id from documents)", 5))
def _(spark, sf):
    r = HybridRetriever(index(spark, sf), C.vectors(spark, sf).select("id", "embedding"))
    return rounded(r.by_embedding(_searched(spark, sf), 5, {"data_type": "image"}), "distance", "vector_score")


# -- fusion -------------------------------------------------------------------------------------------------------------


def _scaled(s: str) -> str:
    return f"case when abs(max({s}) over (partition by qid) - min({s}) over (partition by qid)) < 1e-12 then 1.0 else ({s} - min({s}) over (partition by qid)) / (max({s}) over (partition by qid) - min({s}) over (partition by qid)) end"


@query("minmax_keyword", f"with {KW} select qid, id, round({_scaled('score')}, 6) as norm_keyword from {C.sql_top('kw', 'score', 50)}")
def _(spark, sf):
    r = scoring.min_max(written_index(spark, sf).search(C.queries(spark, sf), 50), "keyword_score", ("qid",), "norm_keyword")
    return rounded(r.select("qid", "id", "norm_keyword"), "norm_keyword")


@query("minmax_vector", f"with {C.KNN} select qid, id, round({_scaled('1 / (1 + distance)')}, 6) as norm_vector from {C.sql_top('vn', '-distance', 50)}")
def _(spark, sf):
    r = scoring.min_max(knn(C.vectors(spark, sf), C.query_vectors(spark, sf), 50), "vector_score", ("qid",), "norm_vector")
    return rounded(r.select("qid", "id", "norm_vector"), "norm_vector")


SCORES = ("vector_score", "norm_vector", "keyword_score", "norm_keyword", "final_score")
OUT = "qid, id, round(vector_score, 6) as vector_score, round(norm_vector, 6) as norm_vector, round(keyword_score, 6) as keyword_score, round(norm_keyword, 6) as norm_keyword, round(final_score, 6) as final_score, found_by_vector, found_by_keyword, rank::int as rank"
VTOP, KTOP = C.sql_top("vn", "-distance", 50), C.sql_top("kw", "score", 50)
FUSED = f"{KW}, {C.KNN.strip()}, {C.sql_fused(VTOP, KTOP, 10)}"


def hybrid_topk(spark, sf):
    return rounded(retriever(spark, sf).search(C.queries(spark, sf), C.query_vectors(spark, sf)), *SCORES)


query("hybrid_topk", f"with {FUSED} select {OUT} from fused")(hybrid_topk)


@query("hybrid_flags", f"with {FUSED} select found_by_vector, found_by_keyword, count(*) as n from fused group by all")
def _(spark, sf):
    r = retriever(spark, sf).search(C.queries(spark, sf), C.query_vectors(spark, sf))
    return r.groupBy("found_by_vector", "found_by_keyword").agg(F.count("*").alias("n"))


def _both_filtered(kind: str) -> str:
    v = C.sql_top(f"(select vn.* from vn join records using (id) where data_type = '{kind}')", "-distance", 50)
    pool = C.sql_top("kw", "score", 250)
    k = C.sql_top(f"(select p.qid, p.id, p.score from {pool} p join records using (id) where data_type = '{kind}')", "score", 50)
    return f"with {KW}, {C.KNN.strip()}, {C.sql_fused(v, k, 10)} select {OUT} from fused"


@query("hybrid_text_documents", _both_filtered("text"))
def _(spark, sf):
    return rounded(retriever(spark, sf).search_text_documents(C.queries(spark, sf), C.query_vectors(spark, sf)), *SCORES)


@query("hybrid_images", _both_filtered("image"))
def _(spark, sf):
    return rounded(retriever(spark, sf).search_images(C.queries(spark, sf), C.query_vectors(spark, sf)), *SCORES)


@query("hybrid_multimodal", f"with {KW}, {C.KNN.strip()}, {C.sql_fused(VTOP, KTOP, 5, 0.5, 0.5)} select {OUT} from fused")
def _(spark, sf):
    r = HybridRetriever(written_index(spark, sf), C.vectors(spark, sf).select("id", "embedding"), 0.5, 0.5, 10)
    return rounded(r.search_multimodal(C.queries(spark, sf), C.query_vectors(spark, sf), 5), *SCORES)


@query("presentation", f"with {FUSED} select qid, fused.id, rank::int as rank, source_path, file_name as display_name, case when coalesce({C.sql_collapse('content')}, '') = '' then case when data_type = 'image' then '{text.IMAGE_PLACEHOLDER}' else '{text.TEXT_PLACEHOLDER}' end when length({C.sql_collapse('content')}) <= 240 then {C.sql_collapse('content')} else substr({C.sql_collapse('content')}, 1, 240) || '…' end as snippet, case when found_by_vector and found_by_keyword then 'both' when found_by_vector then 'vector' else 'keyword' end as match_source from fused join records using (id)")
def _(spark, sf):
    r = retriever(spark, sf)
    shown = r.present(r.search(C.queries(spark, sf), C.query_vectors(spark, sf)))
    return shown.select("qid", "id", "rank", "source_path", "display_name", "snippet", "match_source")


# -- evaluation ---------------------------------------------------------------------------------------------------------

TRUTH = f"truth as (select q.qid, a.id from q join analyzed a on contains(a.norm, q.qnorm))"
METRICS = "count(*) as n_queries, round(avg((coalesce(rank, 1000) <= 1)::int), 6) as recall_at_1, round(avg((coalesce(rank, 1000) <= 5)::int), 6) as recall_at_5, round(avg((coalesce(rank, 1000) <= 10)::int), 6) as recall_at_10, round(avg(coalesce(1 / rank, 0)), 6) as mrr"
MEASURES = ("recall_at_1", "recall_at_5", "recall_at_10", "mrr")


def truth(spark, sf, i):
    """(qid, id): documents that hold a benchmark passage; found among those that hold its rarest inner token.

    Passages of one or two words have no inner token: these few are looked for in all texts.
    """
    q = C.queries(spark, sf).select("qid", text.normalize_text(F.col("query")).alias("qnorm"))
    toks = q.select("qid", F.explode(F.array_distinct(text.split_tokens(F.col("qnorm")))).alias("tok"))
    df = toks.join(i.document_frequency(), "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # first and last tokens may be parts of longer ones in a document, so the inner tokens decide
    inner = _inner(q)
    rare = df.join(inner, ["qid", "tok"]).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("df", "tok"))).where("n = 1").select("qid", "tok")
    # texts stay where they are: the tokens, one a query, go to them
    words = rare.agg(F.collect_set("tok")).scalar()
    found = i.analyzed().select("id", "norm", F.explode(F.array_intersect("toks", words)).alias("tok"))
    found = found.join(F.broadcast(rare.join(q, "qid")), "tok")
    found = found.where(F.contains("norm", "qnorm")).select("qid", "id")
    short = q.join(inner.select("qid").distinct(), "qid", "left_anti")
    if short.isEmpty():
        return found
    return found.unionByName(i.analyzed().select("id", "norm").join(F.broadcast(short), F.contains("norm", "qnorm")).select("qid", "id"))


def _inner(q):
    words = F.split("qnorm", " ")
    inner = F.filter(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), text.clean_token), lambda t: t != "")
    return q.select("qid", F.explode(F.array_distinct(inner)).alias("tok"))


def _ranks(name: str) -> str:
    return f"(select t.qid, r.rank from (select distinct qid from truth) t left join (select f.qid, min(f.rank) as rank from {name} f join truth using (qid, id) group by f.qid) r using (qid))"


@query("recall_mrr", f"with {FUSED}, {TRUTH} select {METRICS} from {_ranks('fused')}")
def _(spark, sf):
    r = retriever(spark, sf)
    found = r.search(C.queries(spark, sf), C.query_vectors(spark, sf))
    return rounded(evaluate.metrics(evaluate.first_relevant(found, truth(spark, sf, r.index))), *MEASURES)


@query("recall_mrr_keyword", f"with {KW}, {TRUTH} select {METRICS} from {_ranks(KTOP)}")
def _(spark, sf):
    i = written_index(spark, sf)
    found = i.search(C.queries(spark, sf), 50)
    return rounded(evaluate.metrics(evaluate.first_relevant(found, truth(spark, sf, i))), *MEASURES)


SWEEPS = ", ".join(C.sql_fused("v50", "k50", 10, a, b, f"f{n}") for n, (a, b) in enumerate(evaluate.SWEEP))
SWEEP_SQL = f"with {KW}, {C.KNN.strip()}, {TRUTH}, v50 as {VTOP}, k50 as {KTOP}, {SWEEPS} " + " union all ".join(
    f"select {a}::double as vector_weight, {b}::double as keyword_weight, {METRICS} from {_ranks(f'f{n}')}" for n, (a, b) in enumerate(evaluate.SWEEP)
)


@query("weight_sweep", SWEEP_SQL)
def _(spark, sf):
    r = retriever(spark, sf)
    k, v = r.keyword(C.queries(spark, sf), 50), r.by_embedding(C.query_vectors(spark, sf), 50)
    return rounded(evaluate.weight_sweep(v, k, truth(spark, sf, r.index)), *MEASURES)


@query("pairwise_eval", f"""with h as (select a.vec_id as qid, a.label, list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: z[1] + 1.5 * z[2]) as x from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 50 = 0),
p as (select qid, vec_id as cid, {DOT('x', 'embedding::double[]')} / (sqrt({DOT('x', 'x')}) * sqrt({DOT('embedding::double[]', 'embedding::double[]')})) as s from h join embeddings using (label)),
r as (select qid, cid, row_number() over (partition by qid order by round(s, 9) desc, cid) as rank from p) select {METRICS} from r where qid = cid""")
def _(spark, sf):
    e = C.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", "other", lambda x, y: x.cast("double") + 1.5 * y.cast("double"))
    left = e.where("vec_id % 50 = 0").join(nxt, "vec_id").select(F.col("label").alias("key"), F.col("vec_id").alias("qid"), mixed.alias("embedding"))
    right = e.select(F.col("label").alias("key"), F.col("vec_id").alias("cid"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(evaluate.metrics(evaluate.pairwise_ranks(evaluate.cosine_pairs(left, right))), *MEASURES)


# -- maintenance --------------------------------------------------------------------------------------------------------


def _state(i: KeywordIndex):
    """Number of documents, tokens and postings of an index."""
    p = i.postings().agg(F.count("*").alias("n_postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    return p.withColumn("n_docs", i.docs.agg(F.count("*")).scalar())


def _state_sql(where: str) -> str:
    return f"with {C.ANALYZED} select (select count(*) from records where {where}) as n_docs, count(*) as n_postings, coalesce(sum(tf), 0)::bigint as n_tokens from postings join records using (id) where {where}"


@query("remove_document", _state_sql("id <> '3'"))
def _(spark, sf):
    return _state(index(spark, sf).remove_document("3").remove_document("no such id"))


@query("remove_by_path", _state_sql("source_path <> 'src4/doc_4.txt'"))
def _(spark, sf):
    return _state(index(spark, sf).remove_by_source_path("src4/doc_4.txt"))


@query("reindex_upsert", f"""with {C.RECORDS.strip()}, up as (select doc_id::varchar as id, source || '/new.txt' as source_path, c.text as content from documents join (select conv_id, max(text) as text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n = 1 group by conv_id) c on conv_id = doc_id)
select id, source_path, md5(coalesce(content, '')) as content_md5 from up union all select id, source_path, md5(coalesce(content, '')) from records where id not in (select id from up)""")
def _(spark, sf):
    c = C.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("said"))
    d = C.table(spark, sf, "documents").join(c, "doc_id")
    empty = F.lit(None).cast(C.records(spark, sf).schema["metadata"].dataType)
    new = d.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/new.txt")).alias("source_path"), F.col("said").alias("content"), empty.alias("metadata"), "turn")
    docs = index(spark, sf).add_documents(new, "turn").docs
    return docs.select("id", "source_path", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"))


@query("clear_index", "select 0::bigint as n_docs, 0::bigint as n_postings, 0::bigint as n_tokens")
def _(spark, sf):
    return _state(index(spark, sf).clear())


@query("batch_progress", f"with {C.RECORDS} select id::int as position, row_number() over (order by id::int) as processed_count, (select count(*) from records) as total_count, content is not null as is_success from records")
def _(spark, sf):
    r = C.records(spark, sf).select(F.col("id").cast("int").alias("position"), F.col("source_path").alias("path"), F.col("content").isNotNull().alias("is_success"))
    return files.batch_progress(r).drop("path")


@query("id_collisions", f"with {C.RECORDS.strip()}, i as (select lower(trim(regexp_replace(regexp_extract(source_path, '^[^/]+'), '[^a-zA-Z0-9]+', '_', 'g'), '_')) as path_id, source_path from records) select path_id, count(distinct source_path) as n_paths from i group by path_id having count(distinct source_path) > 1")
def _(spark, sf):
    p = C.records(spark, sf).select(text.path_id(F.regexp_extract("source_path", "^[^/]+", 0)).alias("path_id"), "source_path")
    return p.groupBy("path_id").agg(F.count_distinct("source_path").alias("n_paths")).where("n_paths > 1")


@query("streaming_ingest", f"with {CHUNKS} select lower(trim(regexp_replace(p, '[^a-zA-Z0-9]+', '_', 'g'), '_')) || '_chunk_' || chunk_index as id, p as source_path, md5(chunk) as content_md5 from (select *, concat_ws('/', source, 'doc_' || doc_id || '.txt') as p from chunks join documents using (doc_id))")
def _(spark, sf):
    """A finite stream of the documents through chunking and upsert: equals the batch chunking (see the tests)."""
    from ..sources.versioned import VersionedTable
    from ..streaming import ingest

    base = f"{C.shared_dir(spark)}/lodestone-stream-{uuid.uuid4().hex}"
    folder, names = C.stream_source(spark, f"{sf}/documents.parquet")
    stream = spark.readStream.schema(C.table(spark, sf, "documents").schema).option("pathGlobFilter", names).parquet(folder)
    docs = stream.select(F.concat_ws("/", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    table = VersionedTable(spark, f"{base}/chunks", ingest.CHUNKS, key="source_path")
    ingest.ingest(docs, table, f"{base}/checkpoint").awaitTermination()
    return table.read().select("id", "source_path", F.md5("content").alias("content_md5"))
