"""Recipes that turn raw corpora into evaluation sets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text


def question_answers(raw: DataFrame, n: int = 500) -> DataFrame:
    """(question, answer) of the first n rows that have both."""
    return raw.dropna(subset=["query", "answer"]).limit(n).select(F.col("query").alias("question"), "answer")


def first_captions(images: DataFrame, annotations: DataFrame, existing: DataFrame | None = None, n: int | None = 500) -> DataFrame:
    """(file_name, caption): the first annotation of each image by position, of images whose files exist.

    images: (id, file_name), annotations: (position, image_id, caption), existing: (file_name).
    """
    j = annotations.join(images, annotations["image_id"] == images["id"]).select("position", "file_name", text.caption_line(F.col("caption")).alias("caption"))
    w = Window.partitionBy("file_name").orderBy("position")
    j = j.withColumn("n", F.row_number().over(w)).where("n = 1")
    if existing is not None:
        bare = F.regexp_replace("file_name", "^0+", "")
        known = existing.select(F.col("file_name").alias("k")).unionByName(existing.select(bare.alias("k"))).distinct()
        j = j.join(known, (F.col("file_name") == F.col("k")) | (bare == F.col("k")), "left_semi")
    j = j.orderBy("position")
    return (j.limit(n) if n else j).select("file_name", "caption")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text) of a dump in XML, compressed or not."""
    schema = "id string, title string, revision struct<text: string>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select(F.coalesce("id", F.lit("0")).alias("page_id"), "title", F.col("revision.text").alias("text"))


def wiki_chunks(pages: DataFrame, size: int = 300, more_than: int = 50) -> DataFrame:
    """(id, title, text): plain windows of words of pages that are neither redirects nor project or template pages."""
    t, raw = F.col("title"), F.col("text")
    kept = pages.where(t.isNotNull() & (F.coalesce(raw, F.lit("")) != "") & ~raw.startswith("#REDIRECT") & ~t.startswith("Wikipedia:") & ~t.startswith("Template:"))
    flat = text.collapse(text.wiki_clean(raw))
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int"))), lambda i: F.slice(w, i * size + 1, size))
    parts = F.get(F.transform(F.array(F.split(flat, " ")), windows), 0)
    chunks = kept.select("page_id", "title", F.posexplode(parts).alias("n", "words")).where(F.size("words") > more_than)
    return chunks.select(F.concat_ws("_", "page_id", F.col("n").cast("string")).alias("id"), "title", F.array_join("words", " ").alias("text"))


def train_validation(df: DataFrame, n: int, key: str = "id", most: int = 1000, share: float = 0.2, seed: str = "split") -> DataFrame:
    """df with a column split: of n rows, min(most, share x n) are validation, drawn by a hash of the key."""
    ranked = df.select(key, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))).alias("__h"))
    chosen = ranked.orderBy("__h", key).limit(min(most, int(n * share))).select(key, F.lit("validation").alias("split"))
    return df.join(chosen, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stratified(df: DataFrame, label: str, order: Column, n: int = 50) -> DataFrame:
    """At most n rows of each label."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def stop_words(words: DataFrame) -> DataFrame:
    """(word): trimmed, lower-cased, distinct, sorted; blank ones dropped."""
    w = F.lower(F.trim(words[words.columns[0]]))
    return words.select(w.alias("word")).where("word <> ''").distinct().orderBy("word")


def load_stop_words(path: str) -> list[str]:
    """A word list file: a JSON array (other values than strings are dropped) or lines with # comments."""
    raw = Path(path).read_text(encoding="utf-8").strip()
    if raw.startswith("["):
        items = [x for x in json.loads(raw) if isinstance(x, str)]
    else:
        items = [x for x in raw.splitlines() if not x.strip().startswith("#")]
    return list(dict.fromkeys(w for x in items if (w := x.strip().lower())))
