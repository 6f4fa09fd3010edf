"""Every registered query runs; those with an SQL twin equal it."""

from __future__ import annotations

import os

import pytest
from compare import compare

from lodestone.functions import text
from lodestone.plans import catalogue, text_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_word_pieces_by_brute_force(spark):
    import hashlib
    import re

    from lodestone.functions.tokenizers import word_pieces

    vocabulary = text_queries.toy_vocabulary()
    got = {r.doc_id: r for r in catalogue.QUERIES["word_pieces"](spark, SF).collect()}
    for r in text_queries.documents(spark, SF).collect():
        words = re.findall(r"[a-z0-9]+|[^\sa-z0-9]", r.text.lower())
        pieces = [p for w in words for p in word_pieces(w, vocabulary)]
        assert got[r.doc_id].pieces_md5 == hashlib.md5(" ".join(pieces).encode()).hexdigest()


@pytest.mark.parametrize("name", ["clip_encode", "embed_batch"])
def test_runs(spark, name):
    n = text_queries.documents(spark, SF).count()
    assert catalogue.QUERIES[name](spark, SF).count() == n


def test_streaming_query_equals_batch(spark):
    got = {(r.id, r.content_md5) for r in catalogue.QUERIES["streaming_ingest"](spark, SF).collect()}
    want = text_queries.documents(spark, SF).selectExpr("concat(source, '/doc_', doc_id, '.txt') as path", "text").select(text.chunk_words(text_queries.F.col("text")).alias("c"), "path")
    n = want.selectExpr("sum(size(c)) as n").first().n
    assert len(got) == n


@pytest.mark.parametrize("name", ["ordered_match", "phrase_match"])
def test_every_document_is_matched(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() == text_queries.documents(spark, SF).count()


def test_short_passages_count(spark, tmp_path):
    """Passages of one or two words, and one without any searchable character, are averaged over like the others."""
    texts = ["the red planet mars is known for being red", "boil the pasta with tomato", "marsupials live there", "red"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = ["mars", "red planet", "the pasta with tomato", "nowhere", "!!!", "pasta with"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert compare(spark, "recall_mrr_keyword", catalogue.QUERIES["recall_mrr_keyword"], catalogue.ORACLE_SQL["recall_mrr_keyword"], str(tmp_path)) == 1
    found = catalogue.QUERIES["recall_mrr_keyword"](spark, str(tmp_path)).first()
    assert found.n_queries == 5


def test_embed_modes_next_to_half_a_unit(spark, tmp_path):
    """170 / norm lies so near half a unit of the fourth place that a float of it is rounded to the other side."""
    n = [101, 16, 0, 44, 182, 14, 8, 155, 74, 0, 0, 30, 1, 170, 94, 0, 0, 72, 62, 191, 13, 0, 14, 0, 18, 0]
    rows = [(1, "".join(chr(97 + k) * c for k, c in enumerate(n)), "en", "s"), (4, "", "en", "s"), (7, "!", "en", "s"), (0, "abc", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, "embed_modes", catalogue.QUERIES["embed_modes"], catalogue.ORACLE_SQL["embed_modes"], str(tmp_path)) == 4
