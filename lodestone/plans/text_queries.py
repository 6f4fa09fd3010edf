"""Queries over text functions, frequencies, tokenizers and curation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import embed, policy, scoring, text, tokenizers
from ..operators.keyword_index import KeywordIndex
from ..sources import curation, files
from . import corpus as C

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


def documents(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def index(spark, sf):
    return KeywordIndex(C.records(spark, sf))


_INDEXES: dict[tuple, KeywordIndex] = {}


def _state(spark, path: str) -> tuple:
    """The files of a table with their sizes and times: equal for as long as nobody writes to it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in found))


def written_index(spark, sf):
    """The index with its tables in the shared folder: built once a session for each state of the documents."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{sf}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = index(spark, sf).written(f"{C.shared_dir(spark)}/lodestone-index-{uuid.uuid4().hex}")
    return _INDEXES[key]


@query("normalize_text", f"select doc_id, {C.sql_norm('text')} as norm from documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("tokenize", f"with n as (select doc_id, {C.sql_norm('text')} as norm from documents), t as (select doc_id, {C.sql_tokens('norm')} as toks from n) select doc_id, len(toks)::bigint as n_tokens, md5(array_to_string(toks, ' ')) as tokens_md5 from t")
def _(spark, sf):
    d = documents(spark, sf).select("doc_id", text.tokenize(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


@query("normalize_token", r"with w as (select distinct unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from documents) select w as word, trim(lower(trim(w)), '.''_-') as token from w")
def _(spark, sf):
    w = documents(spark, sf).select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", text.normalize_token(F.col("word")).alias("token"))


@query("searchable_text", f"with {C.ANALYZED} select id, md5(body) as body_md5, md5(norm) as norm_md5 from analyzed")
def _(spark, sf):
    i = index(spark, sf)
    body = text.searchable_text(F.col("content"), *[i.field(f) for f in ("file_name", "title", "caption", "description")])
    return i.docs.select("id", F.md5(body).alias("body_md5"), F.md5(text.normalize_text(body)).alias("norm_md5"))


CHUNKS = f"""
flat as (select doc_id, string_split({C.sql_collapse('text')}, ' ') as w, {C.sql_collapse('text')} as f from documents),
chunks as (select doc_id, i as chunk_index, array_to_string(w[i * 70 + 1 : i * 70 + 90], ' ') as chunk from (select *, unnest(range(0, greatest(0, ceil((len(w) - 90) / 70.0))::bigint + 1)) as i from flat where f <> ''))
"""


@query("chunk_words", f"with {CHUNKS} select doc_id, chunk_index::int as chunk_index, len(string_split(chunk, ' '))::int as n_words, md5(chunk) as chunk_md5 from chunks")
def _(spark, sf):
    c = documents(spark, sf).select("doc_id", F.posexplode(text.chunk_words(F.col("text"))).alias("chunk_index", "chunk"))
    return c.select("doc_id", "chunk_index", F.size(F.split("chunk", " ")).alias("n_words"), F.md5("chunk").alias("chunk_md5"))


@query("chunk_ids", rf"with {CHUNKS}, {C.RECORDS.strip()} select lower(trim(regexp_replace(source_path, '[^a-zA-Z0-9]+', '_', 'g'), '_')) || '_chunk_' || chunk_index as chunk_id, id from chunks join records on id = doc_id::varchar")
def _(spark, sf):
    r = C.records(spark, sf).select("id", "source_path")
    c = documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.posexplode(text.chunk_words(F.col("text"))).alias("n", "chunk"))
    return c.join(r, "id").select(text.chunk_id(F.col("source_path"), F.col("n")).alias("chunk_id"), "id")


@query("path_ids", "select page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')) as path_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')) || '_image' as image_id from pages")
def _(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", text.path_id(F.col("url")).alias("path_id"), text.image_id(F.col("url")).alias("image_id"))


@query("domain_detect", f"with {C.RECORDS} select id, case when {C.sql_code('source_path')} then 'code' else 'general' end as domain, {C.sql_code('source_path')} as is_code from records")
def _(spark, sf):
    return C.records(spark, sf).select("id", policy.domain_of(F.col("source_path")).alias("domain"), policy.is_code_file(F.col("source_path")).alias("is_code"))


@query("token_weights", f"with {C.ANALYZED} select tok, {C.sql_weight('tok', 'false')} as general_weight, {C.sql_weight('tok', 'true')} as code_weight from freq")
def _(spark, sf):
    w = lambda d: policy.token_weight(F.col("tok"), F.lit(d))
    return index(spark, sf).document_frequency().select("tok", w("general").alias("general_weight"), w("code").alias("code_weight"))


@query("token_weight_for_file", f"with {C.ANALYZED} select id, round(sum({C.sql_weight('tok', 'code')}), 6) as weight from postings group by id")
def _(spark, sf):
    i = index(spark, sf)
    p = i.postings().join(i.docs.select("id", "source_path"), "id")
    return p.withColumn("w", policy.token_weight_for_file(F.col("tok"), F.col("source_path"))).groupBy("id").agg(F.round(F.sum("w"), 6).alias("weight"))


@query("term_freq", f"with {C.ANALYZED} select id, tok, tf from postings")
def _(spark, sf):
    return index(spark, sf).postings().select("id", "tok", "tf")


@query("log_tf", f"with {C.ANALYZED} select id, round(sum(1 + ln(tf)), 6) as log_tf from postings group by id")
def _(spark, sf):
    return index(spark, sf).postings().groupBy("id").agg(F.round(F.sum(scoring.log_tf(F.col("tf"))), 6).alias("log_tf"))


@query("doc_freq", f"with {C.ANALYZED} select tok, df from freq")
def _(spark, sf):
    return index(spark, sf).document_frequency()


@query("df_ratio", f"with {C.ANALYZED} select tok, df, (select count(*) from records) as n_docs, round(df / (select count(*) from records), 9) as ratio from freq")
def _(spark, sf):
    return index(spark, sf).document_frequency_ratio().withColumn("ratio", F.round("ratio", 9))


@query("high_freq_words", f"with {C.ANALYZED} select tok, df from freq where df / (select count(*) from records) >= 0.5")
def _(spark, sf):
    return index(spark, sf).high_frequency_words(0.5).select("tok", "df")


@query("frequent_word_set", f"with {C.ANALYZED}, f as (select tok from freq where df / (select count(*) from records) >= 0.3) select tok as token from f where not list_contains({C.sql_list(policy.lexicon.NEVER_FILTER)}, tok)")
def _(spark, sf):
    return policy.FrequentWords(index(spark, sf).high_frequency_words(0.3).select("tok")).words


@query("idf_table", f"with {C.ANALYZED} select tok, round(ln(((select count(*) from records) + 1) / (df + 1)) + 1, 6) as idf from freq")
def _(spark, sf):
    r = index(spark, sf).document_frequency_ratio()
    return r.select("tok", F.round(scoring.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query("document_count", "select count(*) as n_docs, count(*) = 0 as is_empty from documents")
def _(spark, sf):
    d = C.records(spark, sf)
    return d.agg(F.count("*").alias("n_docs")).withColumn("is_empty", F.col("n_docs") == 0)


PAIRED = f"""
d as (select doc_id, {C.sql_norm("text")} as norm from documents), dt as (select *, doc_id % (select max(item_id) + 1 from benchmark) as turn, {C.sql_tokens("norm")} as toks from d),
b as (select item_id, {C.sql_norm("text")} as qnorm from benchmark), bt as (select *, {C.sql_tokens("qnorm")} as qtoks from b)
"""


def _paired(spark, sf):
    d = documents(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("norm"))
    items = C.table(spark, sf, "benchmark")
    b = items.select("item_id", text.normalize_text(F.col("text")).alias("qnorm"))
    turn = F.pmod("doc_id", items.agg(F.max("item_id") + 1).scalar())  # every document meets an item
    j = d.withColumn("item_id", turn).join(b, "item_id")
    return j.withColumns({"toks": text.split_tokens(F.col("norm")), "qtoks": text.split_tokens(F.col("qnorm"))})


@query("ordered_match", f"with {PAIRED} select doc_id, round(case when len(qtoks) = 0 then 0 else list_reduce(toks, lambda s, x: case when s::int < len(qtoks) and x = qtoks[s::int + 1] then (s::int + 1)::varchar else s end, '0')::int / len(qtoks) end, 9) as ordered from dt join bt on turn = item_id")
def _(spark, sf):
    return _paired(spark, sf).select("doc_id", F.round(scoring.ordered_match(F.col("toks"), F.col("qtoks")), 9).alias("ordered"))


@query("phrase_match", f"with {PAIRED} select doc_id, case when contains(norm, qnorm) then 1.0::double else 0.0::double end as phrase, case when contains(norm, substr(norm, 3, 9)) then 1.0::double else 0.0::double end as inner_phrase from dt join bt on turn = item_id")
def _(spark, sf):
    return _paired(spark, sf).select("doc_id", scoring.phrase_match(F.col("norm"), F.col("qnorm")).alias("phrase"), scoring.phrase_match(F.col("norm"), F.substring("norm", 3, 9)).alias("inner_phrase"))


@query("snippet", f"select doc_id, case when coalesce({C.sql_collapse('text')}, '') = '' then '{text.TEXT_PLACEHOLDER}' when length({C.sql_collapse('text')}) <= 240 then {C.sql_collapse('text')} else substr({C.sql_collapse('text')}, 1, 240) || '…' end as snippet from documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("display_name", f"with {C.RECORDS} select id, coalesce(case when trim(file_name) <> '' then file_name end, regexp_extract(source_path, '[^/]+$')) as name, regexp_extract(source_path, '[^/]+$') as base from records")
def _(spark, sf):
    r = C.records(spark, sf)
    return r.select("id", text.display_name(F.col("metadata.file_name"), F.col("source_path"), F.col("id")).alias("name"), text.base_name(F.col("source_path")).alias("base"))


@query("bert_basic_tokens", f"with t as (select doc_id, regexp_extract_all(lower({C.sql_collapse('text')}), '[a-z0-9]+|[^\\sa-z0-9]') as t from documents) select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from t")
def _(spark, sf):
    t = text.basic_tokens(F.col("text"))
    d = documents(spark, sf).select("doc_id", t.alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("bert_pad", f"""with t as (select doc_id, list_transform(regexp_extract_all(lower({C.sql_collapse('text')}), '[a-z0-9]+|[^\\sa-z0-9]'), lambda x: length(x)::int + 1000) as i from documents),
p as (select doc_id, list_concat(list_concat([101], i[1:126]), [102]) as k from t)
select doc_id, list_concat(k, list_transform(range(0, 128 - len(k)), lambda x: 0))::int[] as input_ids, list_concat(list_transform(range(0, len(k)), lambda x: 1), list_transform(range(0, 128 - len(k)), lambda x: 0))::int[] as attention_mask, list_transform(range(0, 128), lambda x: 0)::int[] as token_type_ids from p""")
def _(spark, sf):
    ids = F.transform(text.basic_tokens(F.col("text")), lambda x: F.length(x) + 1000)
    return documents(spark, sf).select("doc_id", text.pad_ids(ids, 101, 102).alias("p")).select("doc_id", "p.*")


CLEAN = f"lower({C.sql_collapse('''replace(replace(replace(replace(replace(replace(replace(html, chr(65533), ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' ')''')})"


@query("clip_clean", f"select page_id, md5({CLEAN}) as clean_md5, length({CLEAN})::bigint as n_chars from pages")
def _(spark, sf):
    d = C.table(spark, sf, "pages").select("page_id", text.caption_clean_clip(F.col("html")).alias("c"))
    return d.select("page_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("n_chars"))


@query("clip_pretokens", f"with t as (select page_id, regexp_extract_all({CLEAN}, '<start_of_text>|<end_of_text>|''s|''t|''re|''ve|''m|''ll|''d|\\p{{L}}+|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]+') as t from pages) select page_id, len(t)::bigint as n_pieces, md5(array_to_string(t, ' ')) as pieces_md5 from t")
def _(spark, sf):
    d = C.table(spark, sf, "pages").select("page_id", text.clip_pieces(F.col("html")).alias("t"))
    return d.select("page_id", F.size("t").cast("long").alias("n_pieces"), F.md5(F.array_join("t", " ")).alias("pieces_md5"))


WIKI = r"""wiki as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace('== ' || url || ' == [[a|' || url || ']] {{x}} ' || html, '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '\{\{[^|}]*\}\}', '', 'g'), '={2,}\s*(.*?)\s*={2,}', '\1', 'g')) as t from pages)"""


def _wiki(spark, sf):
    p = C.table(spark, sf, "pages")
    raw = F.concat(F.lit("== "), "url", F.lit(" == [[a|"), "url", F.lit("]] {{x}} "), "html")
    return p.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("title"), raw.alias("text"))


@query("wiki_clean", f"with {WIKI} select page_id::varchar as page_id, md5(t) as clean_md5 from wiki")
def _(spark, sf):
    return _wiki(spark, sf).select("page_id", F.md5(text.wiki_clean(F.col("text"))).alias("clean_md5"))


@query("wiki_chunks", f"with {WIKI}, w as (select page_id, string_split({C.sql_collapse('t')}, ' ') as w from wiki), c as (select page_id, i, w[i * 300 + 1 : i * 300 + 300] as part from (select *, unnest(range(0, (len(w) - 1) // 300 + 1)) as i from w)) select page_id || '_' || i as id, len(part)::int as n_words, md5(array_to_string(part, ' ')) as text_md5 from c where len(part) > 50")
def _(spark, sf):
    c = curation.wiki_chunks(_wiki(spark, sf))
    return c.select("id", F.size(F.split("text", " ")).alias("n_words"), F.md5("text").alias("text_md5"))


@query("question_answers", "select d.question, d.answer from (select item_id, text as question, (select max(text) from conversations c where c.conv_id = item_id and c.turn = 0) as answer from benchmark) d where answer is not null order by item_id limit 500")
def _(spark, sf):
    b = C.table(spark, sf, "benchmark")
    c = C.table(spark, sf, "conversations").where("turn = 0").groupBy("conv_id").agg(F.max("text").alias("answer"))
    raw = b.join(c, b["item_id"] == c["conv_id"], "left").select("item_id", F.col("text").alias("query"), "answer")
    return curation.question_answers(raw.orderBy("item_id"))


@query("first_captions", "select file_name, caption from (select 'doc_' || doc_id || '.jpg' as file_name, replace(trim(c.text), chr(10), '') as caption, row_number() over (partition by doc_id order by turn) as n, turn, doc_id from documents join conversations c on conv_id = doc_id) where n = 1")
def _(spark, sf):
    images = documents(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    notes = C.table(spark, sf, "conversations").select(F.struct("turn", "conv_id").alias("position"), F.col("conv_id").alias("image_id"), F.col("text").alias("caption"))
    return curation.first_captions(images, notes, n=None)


@query("stratified_sample", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar)) as n from documents) where n <= 50")
def _(spark, sf):
    return curation.stratified(documents(spark, sf).select("doc_id", "source"), "source", F.md5(F.col("doc_id").cast("string")))


@query("train_validation", "select page_id::varchar as id, case when row_number() over (order by md5('split' || page_id), page_id::varchar) <= least(1000, (0.2 * (select count(*) from pages))::bigint) then 'validation' else 'train' end as split from pages")
def _(spark, sf):
    p = C.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"))
    return curation.train_validation(p, p.count())


@query("word_list", "select distinct lower(trim(w)) as word from (select unnest(string_split(text, ' ')) as w from benchmark) where trim(w) <> ''")
def _(spark, sf):
    return curation.stop_words(C.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")))


ROUTE = "case when lower(p) like '%.txt' then 'txt' when lower(p) like '%.pdf' then 'pdf' when lower(p) like '%.docx' then 'docx' when lower(p) like '%.jpg' or lower(p) like '%.png' then 'image' else 'unknown' end"


@query("file_route", f"with f as (select doc_id, 'x/doc_' || doc_id || ['.TXT', '.pdf', '.Docx', '.jpg', '.png', '.mp4', '.webp'][doc_id % 7 + 1] as p from documents) select doc_id, {ROUTE} as file_type, lower(regexp_extract(p, '[.]([^./]+)$', 1)) in ('txt', 'pdf', 'docx', 'png', 'jpg', 'jpeg', 'bmp', 'webp') as scannable from f")
def _(spark, sf):
    kinds = F.array(*map(F.lit, (".TXT", ".pdf", ".Docx", ".jpg", ".png", ".mp4", ".webp")))
    p = F.concat(F.lit("x/doc_"), F.col("doc_id").cast("string"), F.get(kinds, (F.col("doc_id") % 7).cast("int")))
    return documents(spark, sf).select("doc_id", files.file_type(p).alias("file_type"), files.scannable(p).alias("scannable"))


# -- no SQL form: checked by brute force in the tests -------------------------------------------------------------------


def toy_vocabulary() -> dict[str, int]:
    """Letters, their continuations, digits and a few frequent syllables."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.,!?|'"
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *[f"##{c}" for c in letters], "th", "##er", "##ing", "##tion", "the", "and"]
    return {t: n for n, t in enumerate(tokens)}


# pieces of a basic token: the longest known start, then the longest known continuations
PIECES = rf"""w as (select doc_id, regexp_extract_all(lower({C.sql_collapse('text')}), '[a-z0-9]+|[^\sa-z0-9]') as w from documents),
f as (select doc_id, list_transform(w, lambda x: {{'x': x, 'first': case when regexp_matches(x, '^[a-z0-9.,!?|'']+$') then regexp_extract(x, '^(?:the|and|th|.)') else '[UNK]' end}}) as f from w),
pieces as (select doc_id, flatten(list_transform(f, lambda z: list_concat([z.first], case when z.first = '[UNK]' then [] else list_transform(regexp_extract_all(substr(z.x, length(z.first) + 1), 'tion|ing|er|.'), lambda y: '##' || y) end))) as p from f)"""


@query("word_pieces", f"with {PIECES} select doc_id, len(p)::bigint as n_pieces, md5(array_to_string(p, ' ')) as pieces_md5 from pieces")
def _(spark, sf):
    v = toy_vocabulary()
    d = documents(spark, sf).withColumn("p", tokenizers.bert_pieces(F.col("text"), v))
    return d.select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", " ")).alias("pieces_md5"))


@query("bert_input", f"""with {PIECES}, i as (select doc_id, list_concat(list_concat([2], list_transform(p[1:126], lambda x: list_position({C.sql_list(tuple(toy_vocabulary()))}, x) - 1)), [3]) as k from pieces)
select doc_id, list_concat(k, list_transform(range(0, 128 - len(k)), lambda x: 0))::int[] as input_ids, list_concat(list_transform(range(0, len(k)), lambda x: 1), list_transform(range(0, 128 - len(k)), lambda x: 0))::int[] as attention_mask, list_transform(range(0, 128), lambda x: 0)::int[] as token_type_ids from i""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", tokenizers.bert_input(F.col("text"), toy_vocabulary()).alias("b")).select("doc_id", "b.*")


TOY_MERGES = [("t", "h"), ("th", "e</w>"), ("e", "r"), ("i", "n"), ("in", "g</w>"), ("a", "n"), ("an", "d</w>")]


@query("clip_encode")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", tokenizers.ClipTokenizer(TOY_MERGES).encode(F.col("text")).alias("ids"))


@query("embed_batch")
def _(spark, sf):
    d = documents(spark, sf)
    mode = F.get(F.array(F.lit("text"), F.lit("multimodal_text"), F.lit("image")), (F.col("doc_id") % 3).cast("int"))
    tasks = d.select(F.col("doc_id").cast("string").alias("task_id"), mode.alias("mode"), "text", F.col("text").cast("binary").alias("image"))
    r = embed.EmbeddingEngine().batch(tasks)
    return r.select("task_id", "ok", F.size("vector").alias("dim"), F.round(scoring.dot(F.col("vector"), F.col("vector")), 4).alias("squared_norm"), "error_code")


COUNTS = "list_transform(range(97, 123), lambda c: (length(text) - length(replace(text, chr(c::int), '')))::double)"


@query("embed_modes", f"""with c as (select doc_id, doc_id % 3 as m, text, {COUNTS} as c from documents), n as (select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as norm from c),
r as (select *, case when length(text) = 0 then 'ERR_INVALID_INPUT' when m = 1 and norm = 0 then 'ERR_INFERENCE_FAILED' end as error_code from n)
select doc_id::varchar as task_id, error_code is null as ok, error_code, case when error_code is null then list_transform(c, lambda x: round(case when m = 1 then x / norm else x end, 4)) end as vector from r""")
def _(spark, sf):
    d = documents(spark, sf)
    mode = F.get(F.array(F.lit("text"), F.lit("multimodal_text"), F.lit("image")), (F.col("doc_id") % 3).cast("int"))
    tasks = d.select(F.col("doc_id").cast("string").alias("task_id"), mode.alias("mode"), "text", F.col("text").cast("binary").alias("image"))
    letters = embed.LetterCounts
    # doubles: rounded to float first, a component next to half a unit of the fourth place goes to its other side
    r = embed.EmbeddingEngine(text=letters, multimodal_text=letters, image=letters, component="double").batch(tasks)
    return r.select("task_id", "ok", "error_code", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))
