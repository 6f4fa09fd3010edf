"""The driver's tables as a retrieval corpus, in DataFrames and in SQL.

documents become records with a path whose extension cycles through txt, md, py and json, so both domains occur; every
tenth is an image record (no content, the text as caption). Benchmark items are queries. Vectors belong to the document
and to the query of the same number: a pairing made up for these tables.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_path, content, metadata struct)."""
    d = table(spark, sf_dir, "documents")
    image = F.col("doc_id") % 10 == 9
    extension = F.when(image, ".png").otherwise(F.get(F.array(*map(F.lit, (".txt", ".md", ".py", ".json"))), (F.col("doc_id") % 4).cast("int")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), extension)
    metadata = F.struct(
        F.when(image, "image").otherwise("text").alias("data_type"), name.alias("file_name"), extension.alias("file_extension"),
        F.when(image, F.col("text")).alias("caption"), "lang", F.col("n_chars").alias("n_chars"),
    )
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", name).alias("source_path"), F.when(~image, F.col("text")).alias("content"), metadata.alias("metadata"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): every benchmark item, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    return vectors(spark, sf_dir).join(q, F.col("id") == F.col("qid")).select("qid", "embedding")


# -- the same in SQL --------------------------------------------------------------------------------------------------


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9_.''-]+', ' ', 'g'))"


def sql_tokens(norm: str) -> str:
    return f"list_filter(list_transform(string_split({norm}, ' '), lambda t: trim(t, '.''_-')), lambda t: t <> '')"


def sql_weight(token: str, code: str, frequent: str = "false") -> str:
    return (
        f"case when {token} = '' then 0.0 when list_contains({sql_list(lexicon.NEVER_FILTER)}, {token}) then 1.5 when {code} and list_contains({sql_list(lexicon.CODE_IMPORTANT)}, {token}) then 1.0 "
        f"when {frequent} then 0.1 when list_contains({sql_list(lexicon.STOP_WORDS)}, {token}) then 0.15 else 1.0 end::double"
    )


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B]+', ' ', 'g'))"


def sql_code(path: str) -> str:
    name = f"lower(regexp_extract({path}, '[^/]+$'))"
    return f"(list_contains({sql_list(lexicon.CODE_FILE_NAMES)}, {name}) or list_contains({sql_list(lexicon.CODE_EXTENSIONS)}, regexp_extract({name}, '^.+([.][^.]+)$', 1)))"


RECORDS = """
records as (select doc_id::varchar as id, source || '/' || file_name as source_path, case when not image then text end as content, case when image then 'image' else 'text' end as data_type, file_name, extension as file_extension, case when image then text end as caption, lang, n_chars
    from (select *, 'doc_' || doc_id || extension as file_name from (select *, doc_id % 10 = 9 as image, case when doc_id % 10 = 9 then '.png' else ['.txt', '.md', '.py', '.json'][doc_id % 4 + 1] end as extension from documents)))
"""
ANALYZED = f"""{RECORDS.strip()},
searchable as (select *, trim(concat_ws(' ', nullif(trim(content), ''), file_name, nullif(trim(caption), ''))) as body from (select * replace (case when trim(content) <> '' then content end as content, case when trim(caption) <> '' then caption end as caption) from records)),
normed as (select *, {sql_norm("body")} as norm, {sql_code("source_path")} as code from searchable),
analyzed as (select *, {sql_tokens("norm")} as toks from normed),
postings as (select id, code, tok, count(*) as tf from (select id, code, unnest(toks) as tok from analyzed) group by all),
freq as (select tok, count(*) as df from postings group by tok)
""".replace("nullif(trim(content), '')", "content").replace("nullif(trim(caption), '')", "caption")


def sql_keyword(frequent: str = "false", extra: str = "") -> str:
    """CTEs ending in kw (qid, id, score): the lexical score of every candidate of every benchmark item."""
    squash = lambda x: f"case when {x} <= 0 then 0 else ({x}) / (1 + {x}) end"
    w = "case when p.code then w.w1 else w.w0 end"
    return f"""{ANALYZED.strip()}{extra},
q0 as (select item_id::varchar as qid, {sql_norm("text")} as qnorm from benchmark),
q as (select *, {sql_tokens("qnorm")} as qtoks from q0),
qt as (select qid, unnest(list_distinct(qtoks)) as tok from q),
w as (select qid, tok, {sql_weight("tok", "false", frequent)} as w0, {sql_weight("tok", "true", frequent)} as w1 from qt),
totals as (select qid, sum(w0) as t0, sum(w1) as t1 from w group by qid),
per as (select w.qid, p.id, p.code, sum({w}) as m, sum(({w}) * (1 + ln(p.tf))) as wtf, sum(({w}) * (ln(((select count(*) from records) + 1) / (f.df + 1)) + 1)) as widf
    from postings p join w on p.tok = w.tok join freq f on f.tok = p.tok group by all),
parts as (select per.*, case when per.code then t1 else t0 end as total from per join totals using (qid)),
kw as (select parts.qid, parts.id, least(1.0, 0.45 * m / total + 0.20 * {squash("wtf / total")} + 0.20 * {squash("widf / total")}
    + 0.10 * case when contains(a.norm, q.qnorm) then 1.0 else 0.0 end
    + 0.05 * list_reduce(a.toks, lambda s, x: case when s::int < len(q.qtoks) and x = q.qtoks[s::int + 1] then (s::int + 1)::varchar else s end, '0')::int / len(q.qtoks)) as score
    from parts join q using (qid) join analyzed a on a.id = parts.id where total > 0)"""


def sql_top(source: str, score: str, k: int) -> str:
    return f"(select * from (select *, row_number() over (partition by qid order by round({score}, 9) desc, id) as rank from {source}) where rank <= {k})"


KNN = """
vq as (select item_id::varchar as qid, embedding::double[] as e from benchmark join embeddings on vec_id = item_id),
vn as (select qid, vec_id::varchar as id, label, list_sum(list_transform(list_zip(e, embedding::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance from vq, embeddings)
"""


def sql_fused(vector: str, keyword: str, k: int, vw: float = 0.3, kw: float = 0.7, name: str = "fused") -> str:
    """CTEs ending in `name`: fusion of two candidate relations with (qid, id, distance) and (qid, id, score)."""
    scaled = lambda s: f"case when abs(max({s}) over (partition by qid) - min({s}) over (partition by qid)) < 1e-12 then 1.0 else ({s} - min({s}) over (partition by qid)) / (max({s}) over (partition by qid) - min({s}) over (partition by qid)) end"
    return f"""{name}_v as (select qid, id, 1 / (1 + distance) as vs, {scaled("1 / (1 + distance)")} as nv from {vector}),
{name}_k as (select qid, id, score as ks, {scaled("score")} as nk from {keyword}),
{name}_u as (select coalesce(v.qid, k.qid) as qid, coalesce(v.id, k.id) as id, coalesce(vs, 0) as vector_score, coalesce(nv, 0) as norm_vector, coalesce(ks, 0) as keyword_score, coalesce(nk, 0) as norm_keyword, vs is not null as found_by_vector, ks is not null as found_by_keyword
    from {name}_v v full join {name}_k k on v.qid = k.qid and v.id = k.id),
{name}_f as (select *, least(1.0, greatest(0.0, {vw / (vw + kw)!r} * norm_vector + {kw / (vw + kw)!r} * norm_keyword)) as final_score from {name}_u),
{name} as (select * from (select *, row_number() over (partition by qid order by round(final_score, 9) desc, round(norm_keyword, 9) desc, round(norm_vector, 9) desc, id) as rank from {name}_f) where rank <= {k})"""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local master gets
    one of its own; a cluster has no folder that may be guessed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/lodestone").rstrip("/")


def stream_source(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, name pattern) under which a stream finds a table that is a folder of files or a single file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path, "*.parquet"
    return path.rpartition("/")[0], p.getName()
