"""Scores of documents for a block of queries, in one pass over the texts that leaves no more than a task's best rows.

A document's whole score is known where its text is read, so no (query, document) pair is written or sent: a task keeps
top_k rows a query, and only those go to the ranking.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Most that phrase and order can add to a score.
LATE_PHRASE, LATE_ORDER = 0.10, 0.05
#: Documents read, and (query, token, document) hits summed up, at a time.
DOC_BLOCK, HITS = 256, 1 << 20
#: Words whose numbers a task remembers; beyond it it forgets and begins anew.
REMEMBERED = 500_000
#: Different tokens of a block's queries: each is a character where order is looked for.
TOKENS = 1_000_000
EDGES = ".'_-"
#: Scores are ranked after rounding to nine places; two that share one are no further apart than this, and a bit.
NEAR = 2e-9
_NINE = Decimal("1e-9")
_KINDS = float(1 << 24)
#: Bytes of a normalised text; all others become spaces.
_TABLE = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_.'-" else 32 for c in range(256))


class _Numbers(dict):
    """Number of a word's token among the queries' tokens, or -1."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = self[word] = self.vocabulary.get(word.strip(EDGES), -1)
        return n


def _rounded(score: float) -> float:
    """As F.round(score, 9)."""
    return float(Decimal(repr(score)).quantize(_NINE, ROUND_HALF_UP))


def _first(rows: list[tuple[float, str]], k: int) -> list[tuple[float, str]]:
    """The first k by rounded score, then id; rounding is left to those whose score lies about the k-th."""
    if len(rows) <= k:
        return rows
    edge = sorted((r[0] for r in rows), reverse=True)[k - 1]
    sure = [r for r in rows if r[0] > edge + NEAR]
    near = sorted((r for r in rows if edge - NEAR <= r[0] <= edge + NEAR), key=lambda r: (-_rounded(r[0]), r[1]))
    return sure + near[: k - len(sure)]


def lettered(tokens: list[int]) -> str:
    """A character for each token, so that one is looked for as fast as in a string; those of no query share one."""
    return "".join(map(chr, [t + 1 for t in tokens]))


def in_order(tokens: str, wanted: str) -> int:
    """How many of the wanted tokens come in order, up to the first that never does."""
    at = met = 0
    for t in wanted:
        at = tokens.find(t, at) + 1
        if not at:
            break
        met += 1
    return met


def normalized(rows: DataFrame) -> DataFrame:
    """(id, code, norm) of (id, code, lowered): as text.normalize_text() of what was lowered.

    The pattern there replaces runs of characters one by one, which takes most of the time of analysing a text; here
    bytes are looked up in a table. Bytes of other characters than ASCII are never among those that stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [b" ".join(x.translate(_TABLE).split()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm, pa.binary()).cast(pa.string())], names=["id", "code", "norm"])

    return rows.select("id", "code", F.col("lowered").cast("binary")).mapInArrow(run, "id string, code boolean, norm string")


def counted(rows: DataFrame) -> DataFrame:
    """(tok, df) of (norm): texts that hold each token, summed up within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(df, pa.string()), pa.array(df.values(), pa.int64())], names=["tok", "df"])
        for batch in batches:
            for norm in batch.column(0).to_pylist():
                for t in {w.strip(EDGES) for w in set(norm.split(" "))}:
                    df[t] = df.get(t, 0) + 1
                if len(df) > REMEMBERED:
                    yield out()
                    df.clear()
        yield out()

    return rows.select("norm").mapInArrow(run, "tok string, df long").where("tok <> ''").groupBy("tok").agg(F.sum("df").alias("df"))


def scan(rows: DataFrame, asked: list, n_docs: int, top_k: int, qid_type) -> DataFrame:
    """(qid, id, keyword_score): the top_k documents of each task for each query, by rounded score, then id.

    rows: (id, code, norm, bag, norms). bag and norms are null but for ids that stand in several rows: these have in bag
    all text that their frequencies come from, and in norms every text that phrase and order are looked for in.
    asked: rows of (qid, qnorm, qtoks, wanted), wanted being structs (tok, times, w0, w1, df); df is null for a token that
    no document holds. All queries together may have a million tokens (TOKENS).
    """
    nq = len(asked)
    found = {w["tok"]: w["df"] for a in asked for w in a["wanted"] if w["df"] is not None}
    vocabulary = {t: n for n, t in enumerate(sorted(found))}
    idf = np.array([np.log((n_docs + 1) / (found[t] + 1)) + 1 for t in vocabulary])
    entries = sorted((vocabulary[w["tok"]], q, w["w0"], w["w1"], w["times"]) for q, a in enumerate(asked) for w in a["wanted"] if w["df"] is not None)
    token, query = np.array([e[0] for e in entries], dtype=np.int64), np.array([e[1] for e in entries], dtype=np.int64)
    n_entries = len(entries)
    weight = np.array([[e[2] for e in entries], [e[3] for e in entries]], dtype=np.float64).ravel()
    rarity = weight * np.tile(idf[token] if n_entries else np.zeros(0), 2)
    counts = np.array([_KINDS + e[4] for e in entries], dtype=np.float64)
    begins = np.searchsorted(token, np.arange(len(vocabulary) + 1))
    total = np.array([[sum(w[c] for w in a["wanted"]) for a in asked] for c in ("w0", "w1")], dtype=np.float64)
    kinds, words = np.array([len(a["wanted"]) for a in asked]), np.array([len(a["qtoks"]) for a in asked])
    phrases, ordered = [a["qnorm"] for a in asked], [lettered([vocabulary.get(t, len(vocabulary)) for t in a["qtoks"]]) for a in asked]
    qids, qid_arrow = [a["qid"] for a in asked], to_arrow_type(qid_type)

    def parts(code: np.ndarray, row: np.ndarray, tok: np.ndarray, tf: np.ndarray):
        """(row, early, times, kinds met) of runs of documents, matrices with a column a query."""
        hits = begins[tok + 1] - begins[tok]
        ends = np.searchsorted(row, np.arange(len(code) + 1))
        sums = np.concatenate([[0], np.cumsum(hits)])
        at = 0
        while at < len(code):
            to = at + 1
            while to < len(code) and sums[ends[to + 1]] - sums[ends[at]] <= HITS:
                to += 1
            a, b = ends[at], ends[to]
            n, h = to - at, hits[a:b]
            rep = np.repeat(np.arange(a, b), h)
            e = np.arange(len(rep)) - np.repeat(np.cumsum(h) - h, h) + begins[tok[rep]]
            key = (row[rep] - at) * nq + query[e]
            own = e + n_entries * code[row[rep]]
            w = weight[own]
            add = lambda x: np.bincount(key, x, n * nq).reshape(n, nq)  # noqa: E731, B023
            t = total[code[at:to]]
            squash = lambda x: x / (1 + x)
            met = add(counts[e])
            with np.errstate(invalid="ignore", divide="ignore"):
                early = 0.45 * add(w) / t + 0.20 * squash(add(w * (1 + np.log(tf[rep]))) / t) + 0.20 * squash(add(rarity[own]) / t)
            n_kinds = np.floor(met / _KINDS)
            yield at, np.where((n_kinds > 0) & (t > 0), early, -1.0), met - n_kinds * _KINDS, n_kinds
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(vocabulary)
        best: list[list[tuple[float, str]]] = [[] for _ in range(nq)]
        floor = np.zeros(nq)

        for batch in batches:
            for start in range(0, batch.num_rows if vocabulary else 0, DOC_BLOCK):
                ids, code, norm, bag, norms = (c.to_pylist() for c in batch.slice(start, DOC_BLOCK).columns)
                known = [list(map(numbers.__getitem__, (n if b is None else b).split(" "))) for n, b in zip(norm, bag, strict=True)]
                flat = np.fromiter(chain.from_iterable(known), dtype=np.int64)
                row = np.repeat(np.arange(len(ids)), [len(k) for k in known])
                pairs, tf = np.unique((row * len(vocabulary) + flat)[flat >= 0], return_counts=True)
                several = np.array([b is not None for b in bag])[:, None]
                texts: dict[int, list] = {}
                for at, early, times, n_kinds in parts(np.array(code, dtype=np.int64), pairs // len(vocabulary), pairs % len(vocabulary), tf):
                    apart = several[at : at + len(early)]
                    # order can count only tokens that are there; a phrase may lack its first and its last token, parts of longer ones
                    maybe = apart | (n_kinds >= kinds - 2)
                    most = early + LATE_ORDER * np.where(apart, 1.0, times / words) + np.where(maybe, LATE_PHRASE, 0.0)
                    if len(early) >= top_k:
                        np.maximum(floor, np.partition(early, len(early) - top_k, axis=0)[len(early) - top_k], out=floor)
                    rr, qq = np.nonzero((early >= 0) & (most + NEAR >= floor))
                    for d, q, e, m, least in zip((rr + at).tolist(), qq.tolist(), early[rr, qq].tolist(), maybe[rr, qq].tolist(), (floor[qq] - NEAR).tolist(), strict=True):
                        if d not in texts:
                            split = [(norm[d], known[d])] if norms[d] is None else [(n, list(map(numbers.__getitem__, n.split(" ")))) for n in norms[d]]
                            texts[d] = [(n, lettered(k)) for n, k in split]
                        for n, letters in texts[d]:
                            score = (e + LATE_PHRASE if m and phrases[q] in n else e) + LATE_ORDER * in_order(letters, ordered[q]) / len(ordered[q])
                            if score >= least:
                                best[q].append((min(1.0, score), ids[d]))
                    for q in set(qq.tolist()):
                        if len(best[q]) > top_k:
                            best[q] = _first(best[q], top_k)
                        if len(best[q]) == top_k:
                            floor[q] = max(floor[q], min(best[q])[0])
                if len(numbers) > REMEMBERED:
                    numbers.clear()
        for q, rows_of in enumerate(best):
            if rows_of:
                yield pa.RecordBatch.from_arrays([pa.array([qids[q]] * len(rows_of), qid_arrow), pa.array([x[1] for x in rows_of]), pa.array([x[0] for x in rows_of])], names=["qid", "id", "keyword_score"])

    return rows.select("id", "code", "norm", "bag", "norms").mapInArrow(run, f"qid {qid_type.simpleString()}, id string, keyword_score double")
