"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts the hashed word unigrams and bigrams of every document; the target model counts those of texts
labelled good (at most `max_labelled`, chosen by a hash of their id: a documented bound). A document's log importance
weight is the log ratio of its probabilities under the two models: the sum over its n-grams. Its key is that weight plus
Gumbel noise drawn from a hash of id and text, and the k largest keys stay: a sample of k documents without replacement,
in proportion to their importance weights.

k may be given. Otherwise it is the number of documents in the corpus that look like the target: those whose weight is
no less than a cut that is set on the labelled texts, where losing a share of the good ones costs GOOD times what
keeping that share of the bad ones does. So k follows the corpus and is no fixed share of it.

Length: the weight is a sum, so that long documents have the largest weights of either sign and short ones lie near
zero. Rank among the kept thus depends on length, but who stays hardly does: of documents with many n-grams the sign
decides, and for those of a few words the noise has a say.

The k-th key is found by counting keys in ever finer ranges: no document leaves its task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, scratch, small_batches, table, whole_row

BUCKETS = 16384
MAX_LABELLED = 8192
SEED = "importance"
GOOD = 8
#: Tokens of one text that are held at a time.
BLOCK = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    """CRC-32 of tokens, remembered up to a bound."""

    LIMIT, LONGEST = 100_000, 40

    def __missing__(self, token: str) -> int:
        found = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(token) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = found
        return found


def tokens(text: str) -> Iterator[list[str]]:
    """Lower-case words and runs of marks, in blocks."""
    low = text.lower()
    if len(low) <= BLOCK:
        yield _TOKEN.findall(low)
        return
    found = _TOKEN.finditer(low)
    while block := [m.group() for m in islice(found, BLOCK)]:
        yield block


def features(text: str, known: Hashes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the unigrams and bigrams of a text, repeats included, in blocks."""
    last = np.zeros(0, dtype=np.uint64)
    for block in tokens(text):
        one = np.fromiter(map(known.__getitem__, block), dtype=np.uint64, count=len(block))
        row = np.concatenate([last, one])
        two = row[:-1] * _STEP + row[1:] + np.uint64(1)
        last = row[-1:]
        yield ((np.concatenate([one, two]) * _MIX >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def count(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """n-gram counts of all rows by bucket; each task sends at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, dtype=np.int64), Hashes()
        for b in batches:
            for t in b.column(0):
                for found in features(t.as_py() or "", known, buckets):
                    total += np.bincount(found, minlength=buckets)
        known.clear()
        release_memory()
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:  # at most `buckets` of them
        out[r["bucket"]] = r["n"]
    return out


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def weigh(self, text: str | None, known: Hashes) -> tuple[float, int]:
        """Log importance weight and number of n-grams."""
        weight, n = 0.0, 0
        for found in features(text or "", known, len(self.ratio)):
            weight, n = weight + float(self.ratio[found].sum()), n + len(found)
        return weight, n


def weights(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., weight, n): log importance weight and number of n-grams of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            found = [model.weigh(t.as_py(), known) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*names, "weight", "n"])
        known.clear()
        release_memory()

    chosen = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("text"))
    names = chosen.columns[:-1]
    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names], "weight double", "n long"]))


def _log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of two count vectors; a bucket that neither has counts for nothing."""
    p = (target + 0.5) / (target.sum() + 0.5 * len(target))
    q = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    return np.log(p / q) * ((target + raw) > 0)


def best_threshold(good: list[float], bad: list[float]) -> float:
    """Cut between two weights; losing a share of the good texts costs GOOD times what keeping that share of bad ones does."""
    values = sorted({*good, *bad})
    if not good or not bad:
        return float("-inf")
    good, bad = sorted(good), sorted(bad)
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    g, b = np.searchsorted(good, cuts), np.searchsorted(bad, cuts)
    worth = GOOD * (len(good) - g) / len(good) + b / len(bad)
    return float(cuts[int(np.argmax(worth))]) if cuts else float("-inf")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Target and raw models, and the threshold; without labels of both kinds every document is on the good side."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = scratch(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "quality-labels")  # bounded by max_labelled
    raw = count(docs)
    target = count(texts.where("quality = 1"))
    model = Model(_log_ratio(target, raw), float("-inf"))
    if not target.sum():
        return Model(np.zeros(len(raw)), float("-inf"))
    found = weights(texts, model, "doc_id", "text", ("quality",)).where("n > 0").select("quality", "weight").collect()  # bounded by max_labelled
    model.threshold = best_threshold([r["weight"] for r in found if r["quality"] == 1], [r["weight"] for r in found if r["quality"] == 0])
    return model


def kth_largest(keys: DataFrame, k: int, cells: int = 1024, few: int = 4096) -> tuple[float, str] | None:
    """The k-th largest (key, tie) of a written table with columns key double and tie string; None if k is 0.

    Each round counts the rows of `cells` equal ranges and goes on in the one that holds the k-th; rows reach the
    driver only once `few` are left, or as ties of one key, of which only the k-th tie is read.
    """
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        n = inside.count()
        if n <= few:
            rows = sorted(((r["key"], r["tie"]) for r in inside.select("key", "tie").collect()), reverse=True)
            return rows[min(k, n) - 1]
        width = (high - low) / cells
        if low + width == low:  # a handful of neighbouring values at most: one of them holds the k-th
            for r in sorted(inside.groupBy("key").count().collect(), reverse=True):
                if k <= r["count"]:
                    return r["key"], _kth_tie(inside.where(F.col("key") == r["key"]), k, few)
                k -= r["count"]
        cell = F.least(F.lit(cells - 1), F.floor((F.col("key") - low) / width)).cast("int")
        above = 0
        for r in sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True):
            if above + r["n"] >= k:
                k, low, high = k - above, r["a"], r["b"]
                break
            above += r["n"]


def _kth_tie(rows: DataFrame, k: int, few: int) -> str:
    """The k-th largest tie, two characters at a time."""
    prefix = ""
    while True:
        rows = rows.where(F.col("tie").startswith(prefix))
        counts = sorted(rows.groupBy(F.substring("tie", len(prefix) + 1, 2).alias("c")).count().collect(), reverse=True)
        if sum(r["count"] for r in counts) <= few:
            return sorted((r["tie"] for r in rows.select("tie").collect()), reverse=True)[k - 1]
        for r in counts:
            if k <= r["count"]:
                prefix += r["c"]
                break
            k -= r["count"]
        if not r["c"] or len(prefix) >= 16:
            return prefix


def resample(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, keep: tuple[str, ...] = (), k: int | None = None) -> DataFrame:
    """(id, keep..., weight, n, key, kept): Gumbel top-k over all rows of docs; exactly k rows stay, but for full ties.

    k: see the module. Texts without n-grams (null, empty, blank) have weight 0 and lie on the rejected side: they add
    nothing to k and their keys are lowest. Rows alike in id and text share one key and stay or go together. Empty
    table: empty result.
    """
    tied = docs.withColumn("__tie", _tie(id_col, text_col, seed))
    scored = scratch(weights(tied, model, id_col, text_col, (*keep, "__tie")), "weights")
    scored = scored.withColumns({"__weight": F.col("weight"), "__n": F.col("n"), "__key": _key(F.col("weight"), F.col("n"), F.col("__tie"))})
    return scored.select("id", *keep, "weight", "n", F.col("__key").alias("key"), _kept(scored, model, k).alias("kept"))


def _tie(id_col: str, text_col: str, seed: str) -> Column:
    """Hash that orders equal keys and draws the noise; rows alike in id and text share it."""
    salted = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.xxhash64(F.col(text_col).cast("string")))
    return F.lower(F.lpad(F.hex(salted), 16, "0"))


def _key(weight: Column, n: Column, tie: Column) -> Column:
    uniform = (F.conv(F.substring(tie, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.when(n > 0, weight - F.log(-F.log(uniform))).otherwise(F.lit(-1e300))


def _kept(scored: DataFrame, model: Model, k: int | None = None) -> Column:
    """Whether a row is among the k largest keys; scored: a written table."""
    if k is None:
        k = scored.where((F.col("__n") > 0) & (F.col("__weight") >= model.threshold)).count()
    last = kth_largest(scored.select(F.col("__key").alias("key"), F.col("__tie").alias("tie")), k)
    if last is None:
        return F.lit(False)
    return (F.col("__key") > last[0]) | ((F.col("__key") == last[0]) & (F.col("__tie") >= last[1]))


def kept_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, k: int | None = None) -> DataFrame:
    """The rows of docs, all columns, that resample() keeps. Columns may have any names.

    Documents are written once with their weights; the cut reads only the keys of that table.
    """

    @F.arrow_udf("struct<w: double, n: long>")
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Hashes()
        for part in texts:
            found = [model.weigh(t.as_py(), known) for t in part]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], names=["w", "n"])
        known.clear()
        release_memory()

    # only texts go to Python and only numbers come back; the other columns wait in the JVM
    rows = docs.select(whole_row(docs).alias("doc"), _tie(id_col, text_col, seed).alias("__tie"), weigh(F.col(text_col).cast("string")).alias("__found"))
    rows = rows.select("doc", "__tie", F.col("__found.w").alias("__weight"), F.col("__found.n").alias("__n"))
    scored = scratch(rows, "weighed").withColumn("__key", _key(F.col("__weight"), F.col("__n"), F.col("__tie")))
    return scored.where(_kept(scored, model, k)).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = resample(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), F.col("weight").alias("log_weight"), F.col("n").alias("n_grams"), "key", "kept")
