"""The pipeline stage by stage against plain Python, and the operators' queries through the driver's contract."""

from __future__ import annotations

import collections
import os
import random
import sys
import zlib

import brute
import numpy as np
import pytest
from compare import compare

import corpus_pipeline
from lodestone.llm import importance, mixing, packing, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(9)) for _ in range(n // 9))
    good = [prose(r.randint(60, 150)) for _ in range(80)]
    good += [good[0], good[1] + " end", f"{good[2]}\n{good[3]}", good[4]]
    bad = [" ".join(f"{w}%%%" for w in prose(80).split()) for _ in range(20)]
    texts = [*good, *bad, None, ""]
    rows = [(k, t, "en", None if k % 13 == 3 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < len(good)), 0) for k in range(len(good) + len(bad)) if k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "source mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        out = stage(spark, docs, folder)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            model = importance.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            known = importance.Hashes()
            weighed = {i: model.weigh(r.text, known) for i, r in before.items()}
            clean = {i for i, (w, n) in weighed.items() if n and w >= model.threshold}
            assert {r.doc_id for r in rows} == clean == {i for i, r in before.items() if r.text and "%%%" not in r.text}
        elif k == 1:
            want = brute.lines([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif k == 2:
            fp = {i: brute.simhash(r.text) for i, r in before.items()}
            groups = brute.groups(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
            assert sorted(r.doc_id for r in rows) == sorted(set(groups.values()))
        elif k == 3:
            taken = {r.id: r.taken for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            got = collections.Counter()
            for r in rows:
                got[r.doc_id] += len(brute.WORD.findall(r.text))
            assert got == {i: n for i, n in taken.items() if n}
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(packing.tokenizer_path())
            want = collections.Counter(tuple([*t.encode(x, add_special_tokens=False).ids, 1]) for x in last)
            assert sum(len(x) * n for x, n in want.items()) == sum(r.length for r in rows)
            assert all(zlib.crc32(np.array(r.text_ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
        if k < 4:
            last = [r.text for r in rows]
            before = {r.doc_id: r for r in rows}
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "length").collect())) == sorted(map(str, docs.select("doc_id", "length").collect()))


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.QUERIES.items():
        if name != "op2_embedding_dedup":
            assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


CONTRACT = {
    "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op2_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_importance": {"doc_id", "kept"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"},
    "op9_substring_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op10_line_dedup": {"doc_id", "n_lines_removed", "kept_sha256"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract_columns(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert CONTRACT[name] <= set(df.columns)
    table = "embeddings" if name.startswith("op2_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() >= n if name == "op8_packing" else df.count() == n


def test_library_stands_without_the_subpackage():
    """Nothing outside lodestone/llm imports it."""
    import subprocess

    code = "import sys; sys.modules['lodestone.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
