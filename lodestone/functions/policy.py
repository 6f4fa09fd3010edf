"""Domain of a path and weight of a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .text import base_name, normalize_token

GENERAL, CODE = "general", "code"


def domain_of(path: Column) -> Column:
    """code for known file names and extensions, else general; null and blank paths are general."""
    name = F.lower(base_name(F.trim(path)))
    extension = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    is_code = name.isin(*lexicon.CODE_FILE_NAMES) | extension.isin(*lexicon.CODE_EXTENSIONS)
    return F.when(F.coalesce(is_code, F.lit(False)), CODE).otherwise(GENERAL)


def is_code_file(path: Column) -> Column:
    return domain_of(path) == CODE


def token_weight(token: Column, domain: Column, frequent: Column | None = None, stop_words: tuple[str, ...] = lexicon.STOP_WORDS) -> Column:
    """First match wins: empty, never filtered, important in code, frequent in the corpus, stop word, any other.

    frequent: whether the token is among the corpus' high-frequency words (see high_frequency); off when not given.
    """
    t = normalize_token(token)
    weight = F.when(F.coalesce(t, F.lit("")) == "", 0.0).when(t.isin(*lexicon.NEVER_FILTER), lexicon.WEIGHT_NEVER)
    weight = weight.when((domain == CODE) & t.isin(*lexicon.CODE_IMPORTANT), lexicon.WEIGHT_CODE)
    if frequent is not None:
        weight = weight.when(frequent, lexicon.WEIGHT_FREQUENT)
    return weight.when(t.isin(*stop_words), lexicon.WEIGHT_STOP).otherwise(lexicon.WEIGHT_DEFAULT)


def token_weight_for_file(token: Column, path: Column) -> Column:
    return token_weight(token, domain_of(path))


class FrequentWords:
    """The corpus' high-frequency words as a one-column table (token); never-filter words are left out."""

    def __init__(self, words: DataFrame):
        self.words = self._clean(words)

    @staticmethod
    def _clean(words: DataFrame) -> DataFrame:
        t = words.select(normalize_token(F.col(words.columns[0])).alias("token"))
        return t.where((F.col("token") != "") & ~F.col("token").isin(*lexicon.NEVER_FILTER)).distinct()

    def add(self, words: DataFrame) -> None:
        self.words = self.words.unionByName(self._clean(words)).distinct()

    def clear(self) -> None:
        self.words = self.words.limit(0)

    def mark(self, df: DataFrame, token: str = "tok", name: str = "frequent") -> DataFrame:
        marked = self.words.select(F.col("token").alias("__t"), F.lit(True).alias(name))
        return df.join(marked, df[token] == F.col("__t"), "left").drop("__t").withColumn(name, F.coalesce(name, F.lit(False)))
