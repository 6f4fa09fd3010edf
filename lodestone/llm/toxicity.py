"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct 3- to 6-grams of the lower-cased text, hashed to 2**20 buckets. Class counts of the training
rows are summed in Spark; the buckets that tell the classes apart best (likelihood ratio) are kept, each scaled by its
log-count ratio, and a logistic model with an L2 penalty is fitted to them. Training sees at most `max_labelled`
labelled rows, chosen by a hash of their id (a documented bound). Scoring is one pass over whole texts; long ones are
taken BLOCK characters at a time, so that a task holds the text and its distinct features and not all n-grams at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, scratch, table

BITS, SIZES = 20, (3, 4, 5, 6)
MAX_LABELLED, MAX_FEATURES, MIN_DOCS = 8192, 8192, 3
THRESHOLD = 0.3
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_GAP = "\0" * (SIZES[-1] - 1)
#: Characters hashed at a time.
BLOCK = 200_000


def _hashed(code: np.ndarray, starts: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin at the first `starts` places, size by size."""
    rolled = code.astype(np.uint64)
    code = rolled
    for n in range(2, SIZES[-1] + 1):
        rolled = rolled[:-1] * _STEP + code[n - 1 :]
        if n in SIZES:
            yield (((rolled + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS))[:starts].astype(np.int64)


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, texts, text, bucket) of every n-gram, repeats included; none spans two texts.

    Short texts come together in blocks, long ones in several blocks of their own.
    """
    low = [t.lower() for t in texts]
    at, size = 0, 0
    for k, t in enumerate(low):
        size += len(t)
        if size >= BLOCK or k == len(low) - 1:
            part = low[at : k + 1]
            if size < 2 * BLOCK:
                code = np.frombuffer((_GAP + _GAP.join(part) + _GAP).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                owner = np.repeat(np.arange(len(part), dtype=np.int64), [len(x) + len(_GAP) for x in part])
                for buckets in _hashed(code, len(owner)):
                    yield at, len(part), owner, buckets
            else:
                for j, x in enumerate(part):
                    stream = _GAP + x + _GAP
                    for a in range(0, len(stream) - len(_GAP), BLOCK):
                        piece = stream[a : a + BLOCK + len(_GAP)]
                        starts = len(piece) - len(_GAP)
                        for buckets in _hashed(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4"), starts):
                            yield at + j, 1, np.zeros(starts, dtype=np.int64), buckets
            at, size = k + 1, 0


def distinct(texts: list[str], choose) -> Iterator[tuple[int, np.ndarray]]:
    """(text, distinct features in order) of each text with n-grams; choose maps buckets to features, below 0 for none."""
    for (at, count), found in groupby(grams(texts), key=lambda x: x[:2]):
        held, size = [], 0
        for _, _, owner, buckets in found:
            feature = choose(buckets)
            hit = np.flatnonzero(feature >= 0)
            held.append(owner[hit] << 32 | feature[hit])
            size += len(hit)
            if size > 8 * BLOCK:
                held, size = [np.unique(np.concatenate(held))], 0
        keys = np.unique(np.concatenate(held))
        cuts = np.searchsorted(keys, np.arange(count + 1) << 32)
        for k in range(count):
            yield at + k, keys[cuts[k] : cuts[k + 1]] & 0xFFFFFFFF


def present(texts: list[str]) -> list[np.ndarray]:
    """Distinct buckets of each text."""
    out = [np.zeros(0, dtype=np.int64)] * len(texts)
    for k, found in distinct(texts, lambda buckets: buckets):
        out[k] = found
    return out


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Place of each bucket among the features; -1 for none."""
        found = np.full(1 << BITS, -1, dtype=np.int32)
        found[self.buckets] = np.arange(len(self.buckets))
        return found

    def scores(self, texts: list[str], where: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, found in distinct(texts, where.__getitem__):
            out[k] += self.weights[found].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic model over binary features times scale, by L-BFGS."""
    n, m = len(labels), len(scale)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, weights=(x[:m] * scale)[cols], minlength=n) + x[m]
        e = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = float(np.logaddexp(0, z).sum() - z[labels == 1].sum() + penalty / 2 * (x[:m] @ x[:m]))
        g = np.empty(m + 1)
        g[:m] = np.bincount(cols, weights=(e - labels)[rows], minlength=m) * scale + penalty * x[:m]
        g[m] = (e - labels).sum()
        return value, g

    x = np.zeros(m + 1)
    x[m] = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    f, g = loss(x)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(memory):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        if memory:
            s, y = memory[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(memory, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        t = 1.0
        while t > 1e-8:
            f2, g2 = loss(x - t * d)
            if f2 <= f - 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = -t * d, g2 - g
        if s @ y > 1e-12:
            memory = [*memory, (s, y)][-8:]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = x + s, f2, g2
        if done:
            break
    return x[:m], float(x[m])


def train(labelled: DataFrame, max_features: int = MAX_FEATURES) -> Model:
    """Fit on (text, toxic) rows, which must be few enough for one machine. Without rows of both kinds: a constant model."""
    labelled = scratch(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-labels")
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for y, found in zip(b.column(1).to_pylist(), present([t or "" for t in b.column(0).to_pylist()]), strict=True):
                total[y, found] += 1
        seen = np.nonzero(total.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[1][seen]), pa.array(total[0][seen])], names=["bucket", "p", "q"])

    counts = labelled.mapInArrow(count, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    p, q, n = F.col("p"), F.col("q"), F.col("p") + F.col("q")
    share = pos / (pos + neg)
    gain = term(p, n * share) + term(q, n * (1 - share)) + term(pos - p, (pos + neg - n) * share) + term(neg - q, (pos + neg - n) * (1 - share))
    counts = counts.coalesce(8)  # at most 2**20 rows; each task of the sort below returns max_features of them
    best = counts.where(n >= MIN_DOCS).select("bucket", "p", "q", gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(max_features).collect()
    if not best:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))))
    buckets = np.array([r["bucket"] for r in best], dtype=np.int64)
    ratio = np.array([np.log((r["p"] + 1) / (pos + 2)) - np.log((r["q"] + 1) / (neg + 2)) for r in best])
    where = Model(buckets, ratio, 0.0).table()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [where[x] for x in present([t or "" for t in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[x >= 0].tolist() for x in found], pa.list_(pa.int32()))], names=["toxic", "places"])

    rows = labelled.mapInArrow(chosen, "toxic int, places array<int>").toArrow()
    lengths = np.array([len(x) for x in rows["places"].to_pylist()])
    cols = rows["places"].combine_chunks().flatten().to_numpy()
    weights, bias = fit_logistic(np.repeat(np.arange(len(lengths)), lengths), cols, ratio, rows["toxic"].to_numpy().astype(float))
    return Model(buckets, weights * ratio, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs: the model's probability of toxicity.

    Null and empty texts get the score of no features. Ids pass through; repeated rows stay; other columns are not
    looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = model.table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores([t.as_py() or "" for t in b.column(1)], where))], names=["id", "score"])
        release_memory()

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled rows outside the held-out part, one label per id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # bounded by max_labelled


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(training_rows(docs, table(spark, sf_dir, "labels"))))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
