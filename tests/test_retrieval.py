"""Index, vector store, fusion, engine, sources, evaluation and streaming on small inputs."""

from __future__ import annotations

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import images
from lodestone.functions.embed import EmbeddingEngine, HashingEmbedder
from lodestone.operators import evaluate, hybrid
from lodestone.operators.engine import RetrievalEngine
from lodestone.operators.keyword_index import KeywordIndex, matches
from lodestone.operators.vector_store import VectorStore, knn
from lodestone.sources import curation, files
from lodestone.sources.versioned import VersionedTable
from lodestone.streaming import ingest

RECORD = "id string, source_path string, content string, metadata map<string,string>"


def index(spark, *docs):
    return KeywordIndex(spark.createDataFrame([(i, p, c, m) for i, p, c, m in docs], RECORD))


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid int, query string").withColumn("qid", F.col("qid").cast("string"))


def test_score_by_hand(spark):
    i = index(spark, ("a", "a.txt", "flutter state management tutorial state", {}), ("b", "b.txt", "the state of things", {}), ("c", "c.txt", "", {}))
    got = {r.id: r.keyword_score for r in i.search(ask(spark, "The State management")).collect()}
    n, df = 3, {"the": 1, "state": 2, "management": 1}
    idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in df.items()}
    total = 0.15 + 1 + 1
    squash = lambda v: v / (1 + v)
    a = 0.45 * 2 / total + 0.2 * squash((1 + math.log(2) + 1) / total) + 0.2 * squash((idf["state"] + idf["management"]) / total) + 0 + 0
    b = 0.45 * 1.15 / total + 0.2 * squash(1.15 / total) + 0.2 * squash((0.15 * idf["the"] + idf["state"]) / total) + 0.05 * 2 / 3
    assert got == {"a": pytest.approx(a), "b": pytest.approx(b)}


def test_stop_words_still_find(spark):
    i = index(spark, ("a", "a.txt", "the of", {}), ("b", "b.txt", "other", {}))
    assert [r.id for r in i.search(ask(spark, "the planet")).collect()] == ["a"]


def test_late_terms_are_not_lost(spark):
    """A document that only phrase and order lift into the first place is found with any top_k."""
    docs = [(f"d{k:02}", "x.txt", "red planet " * 3 + f"noise{k}", {}) for k in range(20)] + [("zz", "x.txt", "planet red red planet planet red red planet red planet", {})]
    i = index(spark, *docs)
    everything = [(r.id, round(r.keyword_score, 9)) for r in i.search(ask(spark, "planet red red"), 50).orderBy("rank").collect()]
    assert [(r.id, round(r.keyword_score, 9)) for r in i.search(ask(spark, "planet red red"), 1).collect()] == everything[:1]


def test_empty_queries_and_arguments(spark):
    i = index(spark, ("a", "a.txt", "x y", {}))
    assert i.search(ask(spark, "你好", "")).count() == 0
    with pytest.raises(ValueError):
        i.search(ask(spark, "x"), 0)
    with pytest.raises(ValueError):
        i.high_frequency_words(0)
    assert KeywordIndex.empty(spark).search(ask(spark, "x")).count() == 0


def test_upsert_and_removal(spark):
    i = index(spark, ("a", "p", "one two", {}), ("b", "p", "two", {}), ("c", "q", None, {}))
    new = spark.createDataFrame([("a", "p", "early", {}, 1), ("a", "p", "late word", {}, 2), ("d", "r", "two", {}, 3)], RECORD + ", n int")
    j = i.add_documents(new, "n")
    assert j.document_count() == 4 and {r.tok: r.df for r in j.document_frequency().collect()} == {"late": 1, "word": 1, "two": 2}
    assert {r.tok for r in j.remove_document("b").remove_document("none").document_frequency().collect()} == {"late", "word", "two"}
    assert j.remove_by_source_path("p").document_count() == 2 and j.clear().is_empty()
    assert j.get_document("d").first().content == "two"
    assert {r.tok: r.ratio for r in j.document_frequency_ratio().collect()}["two"] == 0.5


def test_frequency_of(spark):
    i = index(spark, ("a", "p", "Flutter state", {}), ("b", "p", "flutter", {}), ("c", "q", None, {}))
    assert [tuple(i.frequency_of(t).first()) for t in (" Flutter.", "none")] == [("flutter", 2, pytest.approx(2 / 3)), ("none", 0, 0.0)]
    assert KeywordIndex.empty(spark).frequency_of("x").first().ratio == 0.0
    r = i.as_vector_results(i.search(ask(spark, "state"))).first()
    assert (r.id, r.content, r.source_path) == ("a", "Flutter state", "p")


def test_written_index_searches_alike(spark, tmp_path):
    i = index(spark, *[(str(k), "x.py" if k % 2 else "x.txt", f"the word w{k % 7} if w{k % 3}", {}) for k in range(40)])
    q = ask(spark, "if the w1 word", "w2 w6")
    assert sorted(map(tuple, i.written(f"{tmp_path}/i").search(q, 7).collect())) == sorted(map(tuple, i.search(q, 7).collect()))


def test_search_sends_the_best_rows_only(spark, tmp_path):
    """No (query, document) pair is shuffled: 800 documents that share words with 40 queries are 32,000 pairs."""
    docs = [(str(k), "x.txt", " ".join(f"w{(k * j) % 60}" for j in range(1, 40)), {}) for k in range(800)]
    i = index(spark, *docs).written(f"{tmp_path}/i")
    q = ask(spark, *[" ".join(f"w{(k + j) % 60}" for j in range(20)) for k in range(40)])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert i.search(q, 3).count() == 120
    assert written() - before < 60_000


def test_texts_stay_where_they_are(spark, tmp_path):
    """Neither the search for passages nor the presentation of a result shuffles texts: 300 of 6 kB that hardly compress."""
    import hashlib

    from lodestone.plans import catalogue

    noise = lambda k: " ".join(hashlib.sha256(f"{k}:{j}".encode()).hexdigest() for j in range(90))
    rows = [(k, f"needle w{k % 7} {noise(k)}", "en", "s", 1) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"needle w{k} {noise(k)[:90]}") for k in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [0.1, float(k)], 0) for k in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    catalogue.QUERIES["keyword_topk"](spark, str(tmp_path)).collect()  # the index is there from now on
    for name, n in (("recall_mrr_keyword", 1), ("presentation", 50)):
        before = written()
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == n
        catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert written() - before < 3_000_000, name


def test_repeated_ids_and_copies_rank_as_in_sql(spark, tmp_path):
    from compare import compare

    from lodestone.plans import catalogue

    texts = ["the red planet mars"] * 70 + ["planet the mars red", "Marsk I st caf\u00e9\u00a0mars\t\x0bred", "", None, "red - 'planet' . the_ mars..", "if the planet"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(3, "planet of the red mars", "en", "s", 1), (3, "if red", "en", "s", 1), (72, "red", "en", "s", 1), (None, "mars", "en", "s", 1), (None, "mars", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = ["the red planet mars", "if the red red", "ed planet mar", "marsk i st", "nowhere", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("keyword_topk", "keyword_frequent_words", "recall_mrr_keyword"):
        assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) > 0


def test_written_texts_are_normalised_alike(spark, tmp_path):
    odd = ["".join(map(chr, range(at, at + 64))) + "end" for at in (*range(0, 0x300, 64), 0x1E80, 0x2000, 0x2100, 0x2140, 0x3000, 0xFEC0, 0x1F600)]
    i = index(spark, *[(str(k), "x.txt", t, {"title": " A\u0130B "}) for k, t in enumerate(odd)])
    got = {(r.id, r.code, r.norm, tuple(r.toks)) for r in i.written(f"{tmp_path}/i").analyzed().collect()}
    assert got == {(r.id, r.code, r.norm, tuple(r.toks)) for r in i.analyzed().collect()}


def test_filters(spark):
    df = spark.createDataFrame([("a", "p", None, {"data_type": "text", "file_extension": ".pdf"}), ("b", "p", None, {"data_type": "text"}), ("c", "q", None, None)], RECORD)
    assert [r.id for r in df.where(matches(df, {"data_type": "text", "file_extension": ".pdf"})).collect()] == ["a"]
    assert [r.id for r in df.where(matches(df, {"source_path": "q"})).collect()] == ["c"]
    typed = df.select("id", "source_path", "content", F.struct(F.lit(0).alias("chunk_index")).alias("metadata"))
    assert typed.where(matches(typed, {"chunk_index": 0})).count() == 3 and typed.where(matches(typed, {"chunk_index": "0"})).count() == 0
    assert typed.where(matches(typed, {"missing": 1})).count() == 0


def test_post_filter_sees_only_the_cut_list(spark):
    docs = [(f"a{k}", "x.txt", "word " * 9, {"data_type": "image"}) for k in range(5)] + [("t", "x.txt", "word", {"data_type": "text"})]
    r = hybrid.HybridRetriever(index(spark, *docs), spark.createDataFrame([], "id string, embedding array<float>"))
    assert r.keyword_text_documents(ask(spark, "word"), 1).count() == 0
    assert [x.id for x in r.keyword_text_documents(ask(spark, "word"), 2).collect()] == ["t"]


def test_fusion_example(spark):
    v = spark.createDataFrame([("q", "A", 0.9), ("q", "B", 0.5)], "qid string, id string, vector_score double")
    k = spark.createDataFrame([("q", "B", 0.8), ("q", "X", 0.6)], "qid string, id string, keyword_score double")
    got = [(r.id, round(r.final_score, 9), r.found_by_vector, r.found_by_keyword) for r in hybrid.fuse(v, k, 10).orderBy("rank").collect()]
    assert got == [("B", 0.7, True, True), ("A", 0.3, True, False), ("X", 0.0, False, True)]
    for weights in ((0, 0), (-1, 2)):
        with pytest.raises(ValueError):
            hybrid.fuse(v, k, 10, *weights)


def test_knn_blocks_and_ties(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 8)).round(1)
    x[400:] = x[:100]
    v = spark.createDataFrame([(f"{k:03}", e.tolist()) for k, e in enumerate(x)], "id string, embedding array<double>").repartition(3)
    q = v.where("id < '020'").withColumnRenamed("id", "qid")
    want = {}
    for k in range(20):
        d = ((x - x[k]) ** 2).sum(axis=1)
        want[f"{k:03}"] = [f"{j:03}" for j in sorted(range(500), key=lambda j: (round(d[j], 9), j))[:7]]
    for block in (1024, 7):
        got = {}
        for row in knn(v, q, 7, block).orderBy("qid", "rank").collect():
            got.setdefault(row.qid, []).append(row.id)
        assert got == want
    assert knn(v, q.limit(0), 3).count() == 0 and knn(v.limit(0), q, 3).count() == 0


def test_vector_store(spark, tmp_path):
    s = VectorStore(spark, f"{tmp_path}/s", {"bert": 2, "mobileClip": 3}).initialize()
    s.initialize()
    rows = [("a", "p", "x", [1.0, 0.0], "bert", {"k": "v", "source_path": "fake"}), ("b", "p", None, [0.0, 1.0, 0.0], "mobileClip", None), ("c", "q", "y", [0.0, 1.0], "bert", {})]
    schema = "id string, source_path string, content string, embedding array<float>, embedding_type string, metadata map<string,string>"
    s.add_documents(spark.createDataFrame(rows, schema))
    s.add_documents(spark.createDataFrame([], schema))
    assert (s.count("bert"), s.count("mobileClip")) == (2, 1)
    assert s.read().where("id = 'a'").first().metadata == {"k": "v", "source_path": "p", "embedding_type": "bert", "embedding_dimension": "2"}
    q = spark.createDataFrame([("q", [1.0, 0.1])], "qid string, embedding array<double>")
    assert [r.id for r in s.search(q, "bert", 5).orderBy("rank").collect()] == ["a", "c"]
    assert [r.id for r in s.search(q, "bert", 5, {"source_path": "q"}).collect()] == ["c"]
    for bad in (("z", "p", None, [1.0], "bert", None), ("z", "p", None, [float("nan"), 1.0], "bert", None), ("", "p", None, [1.0, 1.0], "bert", None), ("z", "p", None, [1.0, 1.0], "other", None)):
        with pytest.raises(Exception, match="invalid vector document"):
            s.add_documents(spark.createDataFrame([bad], schema))
    assert s.count("bert") == 2
    s.delete_document("a")
    s.delete_by_source_path("p")
    assert [r.id for r in s.read().collect()] == ["c"]
    s.clear("bert")
    assert s.count("bert") == 0
    s.dispose()
    with pytest.raises(RuntimeError):
        s.count("bert")
    assert s.initialize().count("bert") == 0
    with pytest.raises(ValueError):
        s.delete_document(" ")
    with pytest.raises(KeyError):
        s.count("nowhere")


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("b", "n", 1), ("b", "y", 3), ("c", "n", 1)], "qid string, id string, rank int")
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "qid string, id string")
    m = evaluate.metrics(evaluate.first_relevant(ranked, truth)).first()
    assert (m.recall_at_1, m.recall_at_5, m.recall_at_10, m.mrr) == pytest.approx((1 / 3, 2 / 3, 2 / 3, 4 / 9))


def write(folder, **contents):
    for name, data in contents.items():
        (folder / name.replace("_", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return [str(folder / n.replace("_", ".")) for n in contents]


def docx(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 5)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 5, 7) + b"\x01" * 20


def test_file_types(spark):
    names = ["document.TXT", "report.pdf", "data.docx", "photo.jpg", "unknown.mp4", "x.jpeg"]
    df = spark.createDataFrame(list(enumerate(names)), "n int, p string").orderBy("n")
    assert [r.t for r in df.select(files.file_type(F.col("p")).alias("t")).collect()] == ["txt", "pdf", "docx", "image", "unknown", "unknown"]
    assert [r.s for r in df.select(files.scannable(F.col("p")).alias("s")).collect()] == [True, True, True, True, False, True]
    assert files.image_size(PNG) == files.image_size(JPEG) == (7, 5) and files.image_size(b"junk") == files.image_size(b"\xff\xd8\xff") == (0, 0)


def test_parsing(spark, tmp_path):
    paths = write(tmp_path, a_txt="héllo", b_txt=b"\xff\xfe\xff", c_docx=docx("one", "two"), d_png=PNG, e_pdf=b"%PDF", f_mp4=b"") + [str(tmp_path / "missing.pdf")]
    rows = files.parse_files(spark, paths, pdf=lambda b: ["p1", "p2"], ocr=lambda b: "  seen ").orderBy("position").collect()
    assert [r.is_success for r in rows] == [True, False, True, True, True, False, False]
    assert [r.error_code for r in rows] == [None, files.ERR_CRASH, None, None, None, files.ERR_UNSUPPORTED, files.ERR_NOT_FOUND]
    assert [r.extracted_text for r in rows] == ["héllo", None, "one\ntwo", "seen", "p1\np2\n", None, None]
    assert (rows[4].page_count, rows[3].width, rows[3].height, rows[0].file_size, rows[0].file_name) == (2, 7, 5, 6, "a.txt")
    assert files.parse_files(spark, paths[3:5]).where("is_success").count() == 0
    p = files.batch_progress(files.parse_files(spark, [paths[0], paths[-1], paths[2]])).orderBy("position").collect()
    assert [(x.processed_count, x.total_count, x.is_success) for x in p] == [(1, 3, True), (2, 3, False), (3, 3, True)]


def png(pixels, kind=2, filters=None):
    h, w = pixels.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines, step = [], pixels.shape[2]
    flat = pixels.reshape(h, w * step).astype(int)
    for y in range(h):
        f = (filters or [0])[y % len(filters or [0])]
        left = np.concatenate([np.zeros(step, int), flat[y, :-step]])
        up = flat[y - 1] if y else np.zeros(w * step, int)
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([f]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][f]) % 256).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_images(spark):
    r = np.random.default_rng(0)
    rgb = r.integers(0, 256, (10, 6, 3))
    assert (images.decode_png(png(rgb, 2, [0, 1, 2, 3, 4])) == rgb).all()
    rgba = r.integers(0, 256, (5, 4, 4))
    assert (images.decode_png(png(rgba, 6, [4, 3])) == rgba[..., :3]).all()
    grey = r.integers(0, 256, (3, 3, 1))
    assert (images.decode_png(png(grey, 0)) == np.repeat(grey, 3, axis=2)).all()
    df = spark.createDataFrame([("a", bytearray(png(rgb))), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    got = {x.id: x for x in images.image_tensors(df).collect()}
    assert len(got["a"].tensor) == 224 * 224 * 3 and got["a"].tensor[:3] == pytest.approx((rgb[0, 0] / 255).tolist())
    assert got["a"].tensor[-3:] == pytest.approx((rgb[-1, -1] / 255).tolist()) and not got["b"].ok and not got["c"].ok


def test_curation(spark, tmp_path):
    qa = spark.createDataFrame([("q1", "a1"), (None, "x"), ("q2", None), ("q3", "a3")], "query string, answer string")
    assert [tuple(r) for r in curation.question_answers(qa, 5).collect()] == [("q1", "a1"), ("q3", "a3")]
    images = spark.createDataFrame([(1, "001.jpg"), (2, "002.jpg")], "id int, file_name string")
    notes = spark.createDataFrame([(0, 2, " b\n2 "), (1, 1, "first"), (2, 1, "second"), (3, 9, "none")], "position int, image_id int, caption string")
    assert [tuple(r) for r in curation.first_captions(images, notes).collect()] == [("002.jpg", "b2"), ("001.jpg", "first")]
    there = spark.createDataFrame([("001.jpg",)], "file_name string")
    assert [r.file_name for r in curation.first_captions(images, notes, there).collect()] == ["001.jpg"]
    words = " ".join(f"w{k}" for k in range(360))
    dump = f"<m><page><title>T</title><id>4</id><revision><text>== H == {words}</text></revision></page><page><title>R</title><id>5</id><revision><text>#REDIRECT x</text></revision></page><page><title>Template:X</title><id>6</id><revision><text>{words}</text></revision></page></m>"
    (tmp_path / "dump.xml").write_text(dump)
    got = curation.wiki_chunks(curation.wiki_pages(spark, str(tmp_path / "dump.xml"))).orderBy("id").collect()
    assert [(r.id, r.title, len(r.text.split())) for r in got] == [("4_0", "T", 300), ("4_1", "T", 61)]
    (tmp_path / "w.json").write_text('[" The ", 3, "the", "A"]')
    (tmp_path / "w.txt").write_text("# words\n The\n\nthe\nA\n")
    assert curation.load_stop_words(tmp_path / "w.json") == curation.load_stop_words(tmp_path / "w.txt") == ["the", "a"]


def test_embedding_batch(spark):
    rows = [("1", "text", "hello world", None), ("2", "multimodal_text", "hello", None), ("3", "image", None, bytearray(b"abc")), ("4", "text", None, None), ("5", "other", "x", None), ("6", "multimodal_text", "!!!", None), ("7", "text", "boom", None)]

    class Failing(HashingEmbedder):
        def __call__(self, items):
            if items == ["boom"]:
                raise RuntimeError("broken")
            return super().__call__(items)

    tasks = spark.createDataFrame(rows, "task_id string, mode string, text string, image binary")
    got = {r.task_id: r for r in EmbeddingEngine(text=lambda: Failing(768, False)).batch(tasks).collect()}
    assert [got[k].ok for k in "1234567"] == [True, True, True, False, False, False, False]
    assert [len(got[k].vector) for k in "123"] == [768, 512, 512] and np.linalg.norm(got["2"].vector) == pytest.approx(1, abs=1e-4)
    assert got["4"].error_code == "ERR_INVALID_INPUT" and got["7"].error_code == "ERR_INFERENCE_FAILED" and got["7"].error_message == "broken"


def test_versions_are_atomic(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "k int, v string")
    with pytest.raises(RuntimeError):
        t.read()
    t.create()
    for n in range(4):
        t.replace(t.read().unionByName(spark.createDataFrame([(n, "x")], "k int, v string")))
    with pytest.raises(Exception):
        t.replace(t.read().withColumn("v", F.raise_error(F.lit("late failure")).cast("string")))
    assert sorted(r.k for r in t.read().collect()) == [0, 1, 2, 3]


def test_changes_that_meet_are_both_kept(spark, tmp_path):
    """A change that another one overtakes is made again on what that left."""
    t = VersionedTable(spark, f"{tmp_path}/t", "k int, v string", key="v")
    t.create()
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    met = []

    def slow(old):
        if not met:
            met.append(VersionedTable(spark, f"{tmp_path}/t", "k int, v string", key="v").update(lambda rows: rows.unionByName(row(1, "a"))))
        return old.unionByName(row(2, "a"))

    t.update(slow)
    assert sorted(r.k for r in t.read().collect()) == [1, 2]
    t.update(lambda old: old.unionByName(row(3, "b")), lambda _: row(3, "b").select("v"))
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3]


def test_changes_rewrite_the_buckets_that_they_touch(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "k long, v string", key="k", buckets=4)
    t.create()
    t.update(lambda old: old.unionByName(spark.range(100).selectExpr("id k", "'old' v")))
    before = t._latest()[1]["folders"]
    t.update(lambda old: old.where("k <> 7"), lambda old: old.where("k = 7").select("k"))
    after = t._latest()[1]["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert sorted(r.k for r in t.read().collect()) == [k for k in range(100) if k != 7]
    t.update(lambda old: old, lambda old: old.where("k = 1000").select("k"))  # nothing to change
    with pytest.raises(ValueError, match="did not name"):
        t.update(lambda _: spark.range(50).selectExpr("id k", "'x' v"), lambda _: spark.range(1).selectExpr("id k"))
    assert t.read().count() == 99 and len(list((tmp_path / "t").glob("version=*"))) <= 3
    (tmp_path / "t" / "pointer" / f"{t._latest()[0] + 1:09d}").write_text("")  # a writer that broke off at once
    assert t.read().count() == 99


def test_embedding_calls_take_several_items(spark):
    class Counting:
        def __call__(self, items):
            if "bad" in items:
                raise RuntimeError("bad item")
            return np.full((len(items), 2), len(items), dtype=float)

    tasks = spark.createDataFrame([(str(k), "text", "bad" if k == 9 else "x", None) for k in range(10)], "task_id string, mode string, text string, image binary").coalesce(1)
    got = {r.task_id: r for r in EmbeddingEngine(text=Counting, at_once=4).batch(tasks).collect()}
    assert [got[str(k)].vector[0] for k in range(9)] == [4.0] * 8 + [1.0] and got["9"].error_message == "bad item"


def test_stream_takes_the_newest_text(spark, tmp_path):
    rows = [("p.txt", "z earlier", 1), ("p.txt", "a later", 2), ("q.txt", "only", 1)]
    spark.createDataFrame(rows, "path string, text string, modified int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, text string, modified int").parquet(f"{tmp_path}/in")
    table = VersionedTable(spark, f"{tmp_path}/chunks", ingest.CHUNKS, key="source_path")
    ingest.ingest(stream, table, f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.source_path, r.content) for r in table.read().collect()} == {("p.txt", "a later"), ("q.txt", "only")}


ASTRONOMY = "The solar system holds eight planets around the sun. Mars is the planet known for being red because of iron oxide."
COOKING = "Boil the pasta and toss it with tomato sauce and fresh basil leaves before serving."
ACCESS = "WCAG guidelines ask for screen reader support, keyboard navigation and visible focus for accessibility."


def test_engine_end_to_end(spark, tmp_path):
    paths = write(tmp_path, astronomy_txt=ASTRONOMY, cooking_txt=COOKING, accessibility_txt=ACCESS, photo_png=PNG)
    e = RetrievalEngine(spark, str(tmp_path / "store"))
    with pytest.raises(RuntimeError):
        e.index_files(paths)
    e.initialize()
    r = e.index_files([*paths, str(tmp_path / "gone.txt")]).orderBy("position").collect()
    assert [(x.is_success, x.indexed_record_count) for x in r] == [(True, 1)] * 4 + [(False, 0)] and r[4].message == files.ERR_NOT_FOUND
    assert (e.text_count(), e.image_count()) == (3, 1)
    for query, name in (("Which planet is known for being red?", "astronomy.txt"), ("fresh basil pasta", "cooking.txt"), ("WCAG screen reader keyboard focus", "accessibility.txt")):
        first = e.search_text_documents(query).orderBy("rank").first()
        assert first.display_name == name and first.keyword_score > 0
    assert e.search_images("photo.png").orderBy("rank").first().display_name == "photo.png"
    assert e.search_by_image(PNG).first().distance == pytest.approx(0, abs=1e-9)
    (tmp_path / "astronomy.txt").write_text("Saturn has a large ring system of ice. " * 30)
    again = e.reindex_file(paths[0]).first()
    assert again.indexed_record_count == 4 and e.text_count() == 6
    assert e.search_text("Which planet has a large ring system?").orderBy("rank").first().source_path == paths[0]
    (tmp_path / "astronomy.txt").write_bytes(b"\xff\xff")
    assert not e.index_file(paths[0]).first().is_success and e.text_count() == 6
    assert {x.status: x.files for x in e.catalogue_status().collect()} == {"indexed": 3, "failed": 2}
    for bad in (("", 10), ("x", 0), ("你好", 5)):
        with pytest.raises(ValueError):
            e.search_text(*bad)
    assert RetrievalEngine(spark, str(tmp_path / "store")).initialize().text_count() == 6
    e.remove_file(paths[0])
    assert e.text_count() == 2
    e.clear_text()
    e.clear_images()
    assert e.text_count() == e.image_count() == 0 and e.index().is_empty()


def test_streaming_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("word " * 100)
    (folder / "b.txt").write_text("short text")
    table = VersionedTable(spark, f"{tmp_path}/chunks", ingest.CHUNKS)

    def run():
        ingest.ingest(ingest.file_stream(spark, str(folder)), table, f"{tmp_path}/checkpoint").awaitTermination()
        return {(r.id, r.content) for r in table.read().collect()}

    first = run()
    assert len(first) == 3
    (folder / "c.txt").write_text("newly arrived")
    assert len(run()) == 4
    docs = spark.read.format("binaryFile").load(str(folder)).select("path", F.decode("content", "UTF-8").alias("text"))
    assert {(r.id, r.content) for r in ingest.chunked(docs).collect()} == {(r.id, r.content) for r in table.read().collect()}
    assert ingest.index_of(table).search(ask(spark, "newly arrived")).first().id.endswith("c_txt_chunk_0")
