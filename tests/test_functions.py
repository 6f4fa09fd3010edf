"""Scalar functions against worked examples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicon, policy, scoring, text, tokenizers


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in (row or {"x": 1}).items())
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_normalize_and_tokenize(spark):
    t = F.col("t")
    assert value(spark, text.normalize_text(t), t="Flutter, State-Management!! 2024") == "flutter state-management 2024"
    assert value(spark, text.tokenize(t), t="Riverpod's state-management.") == ["riverpod's", "state-management"]
    assert value(spark, text.clean_token(t), t="'flutter.") == "flutter"
    assert value(spark, text.normalize_text(t), t="a\u00a0b\u3000c \n % d") == "a b c d"
    assert value(spark, text.tokenize(t), t="café 你好 ... - _") == ["caf"]
    assert value(spark, text.tokenize(t), t="") == []


def test_searchable_text(spark):
    parts = [F.col("c"), F.col("n"), F.lit(None).cast("string"), F.col("p")]
    row = {"c": None, "n": "sunset.png", "p": "A beautiful sunset over the sea"}
    assert value(spark, text.searchable_text(*parts), **row) == "sunset.png A beautiful sunset over the sea"
    assert value(spark, text.searchable_text(*parts), c="  ", n=" x ", p="") == "x"


@pytest.mark.parametrize(("words", "chunks"), [(0, 0), (1, 1), (90, 1), (91, 2), (160, 2), (161, 3), (200, 3)])
def test_chunks(spark, words, chunks):
    t = " \n ".join(f"w{k}" for k in range(words))
    got = value(spark, text.chunk_words(F.col("t")), t=t)
    assert len(got) == chunks
    if words == 200:
        assert [(c.split()[0], c.split()[-1]) for c in got] == [("w0", "w89"), ("w70", "w159"), ("w140", "w199")]


def test_chunk_arguments():
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            text.chunk_words(None, size, overlap)


def test_wide_spaces(spark):
    assert value(spark, text.collapse(F.col("t")), t="\u00a0a\u2003\u00a0b\ufeff") == "a b"


def test_ids(spark):
    assert value(spark, text.chunk_id(F.col("p"), F.lit(0)), p="E:/docs/合同.pdf") == "e_docs_pdf_chunk_0"
    assert value(spark, text.image_id(F.col("p")), p="E:/photos/Sunset.png") == "e_photos_sunset_png_image"


@pytest.mark.parametrize(("path", "domain"), [("lib/main.dart", "code"), ("C:/docs/requirements.txt", "code"), ("a.txt", "general"), (None, "general"), ("  ", "general"), ("Makefile", "code"), ("a/b.tar.JSON", "code"), (".py", "general"), ("x.py/readme", "general")])
def test_domain(spark, path, domain):
    assert value(spark, policy.domain_of(F.col("p")), p=path) == domain


@pytest.mark.parametrize(("token", "domain", "weight"), [("wcag", "general", 1.5), ("the", "general", 0.15), ("planet", "general", 1.0), ("if", "code", 1.0), ("if", "general", 0.15), ("", "general", 0.0), (" THE. ", "general", 0.15)])
def test_token_weight(spark, token, domain, weight):
    assert value(spark, policy.token_weight(F.col("t"), F.lit(domain)), t=token) == weight
    if token == "planet":
        assert value(spark, policy.token_weight(F.col("t"), F.lit(domain), F.lit(True)), t=token) == 0.10


def test_lexicon():
    assert (len(lexicon.STOP_WORDS), len(lexicon.NEVER_FILTER), len(lexicon.CODE_IMPORTANT), len(lexicon.CODE_EXTENSIONS), len(lexicon.CODE_FILE_NAMES)) == (198, 21, 41, 34, 7)


def test_frequent_words(spark):
    f = policy.FrequentWords(spark.createDataFrame([("The.",), ("wcag",), ("data",)], "w string"))
    assert {r.token for r in f.words.collect()} == {"the", "data"}
    f.add(spark.createDataFrame([("More",)], "w string"))
    assert f.words.count() == 3
    f.clear()
    assert f.words.count() == 0


def test_arithmetic(spark):
    assert value(spark, scoring.squash(F.col("v")), v=3.0) == 0.75 and value(spark, scoring.squash(F.col("v")), v=0.0) == 0.0
    for d, s in ((0.0, 1.0), (1.0, 0.5), (-1.0, 0.0), (float("nan"), 0.0), (float("inf"), 0.0)):
        assert value(spark, scoring.distance_score(F.col("d")), d=d) == s
    assert value(spark, scoring.distance_score(F.lit(None)), x=1) == 1.0


@pytest.mark.parametrize(("query", "doc", "score"), [(["state", "management"], ["flutter", "state", "tutorial", "management", "guide"], 1.0), (["management", "state"], ["flutter", "state", "management"], 0.5), (["absent", "state"], ["state"], 0.0), (["a", "a"], ["a", "b", "a"], 1.0), (["a", "a"], ["a"], 0.5)])
def test_ordered(spark, query, doc, score):
    assert value(spark, scoring.ordered_match(F.col("d"), F.col("q")), q=query, d=doc) == score


def test_phrase_is_not_bound_to_words(spark):
    assert value(spark, scoring.phrase_match(F.lit("a party"), F.lit("art")), x=1) == 1.0


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert value(spark, scoring.cosine(arr(1, 0), arr(0, 0)), x=1) == 0.0
    assert value(spark, scoring.cosine(arr(1, 2), arr(2, 4)), x=1) == pytest.approx(1.0)
    with pytest.raises(Exception, match="differ"):
        value(spark, scoring.cosine(arr(1, 2), arr(1)), x=1)
    assert value(spark, scoring.l2_normalize(arr(3, 4)), x=1) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="zero"):
        value(spark, scoring.l2_normalize(arr(0, 0)), x=1)
    assert value(spark, scoring.valid_vector(arr(1, 2), 2), x=1) and not value(spark, scoring.valid_vector(arr(1, float("nan")), 2), x=1)
    assert not value(spark, scoring.valid_vector(arr(1), 2), x=1) and value(spark, scoring.valid_vector(F.lit(None).cast("array<double>"), 2), x=1) is False


@pytest.mark.parametrize(("scores", "out"), [([0.9, 0.5, 0.5], [1, 0, 0]), ([0.7, 0.7, 0.7], [1, 1, 1]), ([0.5], [1]), ([], [])])
def test_min_max(spark, scores, out):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "k int, s double").withColumn("q", F.lit(1))
    assert [r.n for r in scoring.min_max(df, "s", ("q",), "n").orderBy("k").collect()] == out


def test_presentation(spark):
    assert value(spark, text.snippet(F.col("t")), t="x" * 241) == "x" * 240 + "…"
    assert value(spark, text.snippet(F.col("t")), t="x" * 240) == "x" * 240
    assert value(spark, text.snippet(F.col("t"), F.lit("image")), t=None) == text.IMAGE_PLACEHOLDER
    assert value(spark, text.display_name(F.col("n"), F.col("p"), F.lit("id")), n=" ", p="a/b.txt") == "b.txt"
    assert value(spark, text.display_name(F.col("n"), F.col("p"), F.lit("id")), n=None, p="") == "id"
    assert value(spark, text.display_percent(F.lit(0.98765)), x=1) == "98.8%"
    assert value(spark, text.match_label(F.lit(True), F.lit(False)), x=1) == "vector"


def test_clean_and_split(spark):
    assert value(spark, text.caption_clean_clip(F.col("t")), t=" A&amp;lt;b&nbsp;c\ufffd  D&#39;s ") == "a<b c d's"
    assert value(spark, text.clip_pieces(F.col("t")), t="They're 2024!! <3 你好") == ["they", "'re", "2", "0", "2", "4", "!!", "<", "3", "你好"]
    assert value(spark, text.wiki_clean(F.col("t")), t="== Title ==\n[[A|B]] and [[C]] {{x}} {{a|b}}") == "Title\nB and C  {{a|b}}"
    assert value(spark, text.caption_line(F.col("t")), t=" a\nb ") == "ab"
    assert value(spark, text.basic_tokens(F.col("t")), t="Don't  stop!é") == ["don", "'", "t", "stop", "!", "é"]


def test_padding(spark):
    p = value(spark, text.pad_ids(F.sequence(F.lit(1), F.lit(200)), 101, 102), x=1)
    assert len(p.input_ids) == 128 and p.input_ids[-1] == 102 and p.input_ids[126] == 126 and sum(p.attention_mask) == 128
    p = value(spark, text.pad_ids(F.array().cast("array<int>"), 101, 102), x=1)
    assert p.input_ids[:3] == [101, 102, 0] and sum(p.attention_mask) == 2 and set(p.token_type_ids) == {0}


VOCABULARY = {t: n for n, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##want", "##ed", "a"])}


def test_word_pieces(spark):
    assert tokenizers.word_pieces("unwanted", VOCABULARY) == ["un", "##want", "##ed"]
    assert tokenizers.word_pieces("unx", VOCABULARY) == ["[UNK]"]
    assert value(spark, tokenizers.bert_pieces(F.col("t"), VOCABULARY), t="Unwanted a zzz!") == ["un", "##want", "##ed", "a", "[UNK]", "[UNK]"]
    b = value(spark, tokenizers.bert_input(F.col("t"), VOCABULARY), t="unwanted zzz")
    assert b.input_ids[:7] == [2, 4, 5, 6, 1, 3, 0] and sum(b.attention_mask) == 6
    assert value(spark, tokenizers.token_to_id(F.col("t"), VOCABULARY), t="nope") == 1


def test_byte_letters():
    letters = tokenizers.byte_letters()
    assert len(set(letters.values())) == 256 and letters[ord("a")] == "a" and letters[0] == "Ā" and sum(ord(c) >= 256 for c in letters.values()) == 68


def real_merges():
    found = pytest.importorskip("public_tokenizers")
    model = json.load(open(found.path("word_bpe_49k.json"), encoding="utf-8"))["model"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


def test_clip_golden_ids(spark):
    t = tokenizers.ClipTokenizer(real_merges()[: tokenizers.CLIP_MERGES])
    assert (t.start, t.end) == (49406, 49407)
    encode = lambda s, n=77: value(spark, t.encode(F.col("t"), n), t=s)
    want = [49406, 320, 1125, 539, 320, 2368, 49407]
    assert encode("a photo of a cat") == want + [0] * 70 == encode("  A PHOTO  of\na Cat ")
    assert encode("") == [49406, 49407] + [0] * 75 == encode(" \n\t")
    long = encode("cat " * 200)
    assert len(long) == 77 and long[-1] == 49407 and long[1] == long[75] == 2368
    assert encode("cat dog", 3) == [49406, 2368, 49407]
    with pytest.raises(ValueError):
        t.encode(F.col("t"), 1)


def test_clip_equals_library(spark):
    found = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(found.path("word_bpe_49k.json"))
    ours = tokenizers.ClipTokenizer(real_merges()[: tokenizers.CLIP_MERGES])
    for s in ("internationalization naïve café 你好世界 2024!!! they're", "a" * 50, "mixed-CASE words_with stuff; (and) more..."):
        pieces = value(spark, text.clip_pieces(F.col("t")), t=s)
        assert ours.piece_ids(pieces) == library.encode(s, add_special_tokens=False).ids
