"""Arithmetic of scores: squashing, frequencies, normalisation, fusion, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A narrower range of scores than this counts as all equal.
FLAT = 1e-12
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.3, 0.7


def squash(v: Column) -> Column:
    return F.when(v <= 0, 0.0).otherwise(v / (1 + v))


def log_tf(tf: Column) -> Column:
    return 1 + F.log(tf.cast("double"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def phrase_match(normalized: Column, normalized_query: Column) -> Column:
    """1.0 where the text contains the query as a plain substring, word limits or not."""
    return F.when(F.contains(normalized, normalized_query), 1.0).otherwise(0.0)


def ordered_match(tokens: Column, query_tokens: Column) -> Column:
    """Share of the query's tokens, repeats included, met in order; it stops at the first that never comes."""
    step = lambda a, x: a + F.when((a < F.size(query_tokens)) & (x == F.get(query_tokens, a)), 1).otherwise(0)
    met = F.aggregate(tokens, F.lit(0), step)
    return F.when(F.size(query_tokens) == 0, 0.0).otherwise(met / F.size(query_tokens))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero vector has 0; vectors of different lengths raise an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def distance_score(d: Column) -> Column:
    """1 / (1 + d); 0 for negative, infinite and NaN distances; a missing distance counts as 0."""
    d = F.coalesce(d.cast("double"), F.lit(0.0))
    return F.when(F.isnan(d) | (d < 0) | (d == float("inf")), 0.0).otherwise(1 / (1 + d))


def l2_normalize(v: Column) -> Column:
    """Unit vector as float32; a zero vector raises an error."""
    norm = F.sqrt(dot(v, v))
    unit = F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
    return F.when(norm > 0, unit).otherwise(F.raise_error(F.lit("zero vector")).cast("array<float>"))


def valid_vector(v: Column, dim: int) -> Column:
    """Whether a vector has `dim` components, all finite and not null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def min_max(df: DataFrame, score: str, by: tuple[str, ...], name: str) -> DataFrame:
    """Scores of each group stretched to [0, 1]; groups of one or of equal scores are all 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) - low) / (high - low)))
    return df.withColumn(name, F.when(F.abs(high - low) < FLAT, 1.0).otherwise(scaled))


def fuse_scores(vector: Column, keyword: Column, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> Column:
    """Weighted sum of normalised scores, weights scaled to add up to 1, clamped to [0, 1]."""
    check_weights(vector_weight, keyword_weight)
    total = vector_weight + keyword_weight
    value = F.lit(vector_weight / total) * vector + F.lit(keyword_weight / total) * keyword
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def check_weights(vector_weight: float, keyword_weight: float) -> None:
    if vector_weight < 0 or keyword_weight < 0 or vector_weight + keyword_weight == 0:
        raise ValueError("weights must not be negative nor both zero")
