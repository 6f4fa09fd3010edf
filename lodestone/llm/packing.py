"""Lexical retrieval packing: a BM25 inverted index per shard supplies each seed document's unused neighbours.

One pass tokenizes all documents, writes their ids with a routing key and counts document frequencies and tokens, so
that BM25 has the statistics of the whole corpus. The key is a document's KEY_TERMS least term hashes in order: sets of
terms that resemble each other are likely to begin with the same ones. All rows are range-partitioned and sorted by key,
then position, so that copies and related documents meet wherever they were read, and a key with very many documents is
spread over several tasks. A task then takes its rows in shards of at most `shard_docs` documents (and about
SHARD_TOKENS tokens), indexes their token counts and packs them: the document that opens a window is its seed; the
seed's best-scoring unused documents of the shard follow until the window is full. A document that overlaps the end is
cut, and what is left of it seeds the next window. An open window is carried from shard to shard; what is left when a
task ends is cut into sequences whose lengths are powers of two, so that no sequence needs padding. A seed sees its shard
only: what resembles it under another key is not retrieved.

Tokenizing goes by batches: Arrow splits the texts at white space and numbers the distinct pieces, each of which is put
to the tokenizer once, and the ids are gathered for all words at a time.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, scratch

WINDOW, END_ID = 2048, 1
SHARD_DOCS, SHARD_TOKENS = 512, 2_000_000
K1, B = 1.2, 0.75
KEY_TERMS = 8
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, text_ids array<int>"
#: Bytes of text whose pieces are numbered at a time, and words whose ids are gathered at a time.
SLICE, GATHER = 1 << 24, 1 << 18


# How the tokenizer file splits lower-case ASCII, and the file's normaliser and splitter.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of the Latin blocks that stand alone under composition and lower their case one by one, then at most a mark.
_MARKS = ".,;:!?"
_WORD = f"^[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+[{_MARKS}]?$"
#: Bytes above ASCII as the byte-level step writes them: those that don't print get characters from 256 up.
_BYTE_LETTERS = {b: 256 + 34 + k for k, b in enumerate(range(0x7F + 1, 0xA1))} | {0xAD: 256 + 67}


def _is_plain(tokenizer) -> bool:
    """Whether a tokenizer treats text as _PARTS takes it to; any other is asked for every piece."""
    normalizer, splitter = [json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    steps = [x["type"] for x in normalizer.get("normalizers", [])]
    splits = splitter.get("pretokenizers", [{}])
    byte_level = splits[-1].get("type") == "ByteLevel" and not splits[-1].get("add_prefix_space") and not splits[-1].get("use_regex")
    return steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0].get("pattern") == {"Regex": _SPLIT} and byte_level


def worker_tokenizer(path: str):
    """One tokenizer per Python worker: kept in a module of its own, as functions come anew with each task."""
    kept = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
    known = kept.__dict__.setdefault("tokenizers", {})
    if path not in known:
        from tokenizers import Tokenizer

        known[path] = Tokenizer.from_file(path)
    return known[path]


class Pieces(dict):
    """Token ids (packed uint32) of lower-case words and runs of marks; all are forgotten when there are too many.

    A piece is what lies between ASCII white space; the tokenizer splits there anyway.
    """

    LIMIT, LONGEST = 250_000, 40

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = worker_tokenizer(path)
        self.model = self.tokenizer.model
        marks = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS]
        self.plain = _is_plain(self.tokenizer) and all(len(m) == 1 for m in marks)
        self.marks = np.array([m[0] if m else 0 for m in marks], dtype=np.uint32)

    def __missing__(self, part: str) -> bytes:
        """Ids of a part that needs no normalising."""
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(part) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = found
        return found

    def any_piece(self, piece: str) -> bytes:
        """Ids of a piece that is no plain word. Where normaliser and splitter are known to do no more than lower the
        case and part letters from marks, its parts are put to the model directly."""
        if self.plain and piece.isascii() and piece.isprintable() and "<|" not in piece:
            return b"".join(map(self.__getitem__, _PARTS.findall(piece.lower())))
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, length): the ids of distinct pieces one after the other, and where each piece's lie."""
        n = len(pieces)
        word = pc.match_substring_regex(pieces, _WORD).to_numpy(zero_copy_only=False) if self.plain else np.zeros(n, dtype=bool)
        at, rest = np.flatnonzero(word), np.flatnonzero(~word)
        plain = pieces.take(pa.array(at))
        stems = pc.utf8_lower(pc.utf8_rtrim(plain, characters=_MARKS)).dictionary_encode()
        mark = pc.index_in(pc.utf8_slice_codeunits(plain, -1), value_set=pa.array(list(_MARKS))).fill_null(-1).to_numpy(zero_copy_only=False)
        held = [*map(self.__getitem__, _strings(stems.dictionary)), *map(self.any_piece, _strings(pieces.take(pa.array(rest))))]
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        pool = np.frombuffer(b"".join(held), dtype="<u4")
        source = np.empty(n, dtype=np.int64)
        source[at] = stems.indices.to_numpy(zero_copy_only=False)
        source[rest] = len(stems.dictionary) + np.arange(len(rest))
        stem = lengths[source]
        marked = np.full(n, -1, dtype=np.int64)
        marked[at] = mark
        length = stem + (marked >= 0)
        first = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), dtype=np.uint32)
        begins = np.cumsum(lengths) - lengths
        ids[_places(first, stem)] = pool[_places(begins[source], stem)]
        ids[(first + stem)[marked >= 0]] = self.marks[marked[marked >= 0]]
        return ids, first, length

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; a null is empty."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        done = 0
        while done < len(texts):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, side="right")))
            words = pc.ascii_split_whitespace(texts.slice(done, upto - done))
            offsets = words.offsets.to_numpy().astype(np.int64)
            numbered = words.flatten().dictionary_encode()
            ids, first, length = self.table(numbered.dictionary)
            number = numbered.indices.to_numpy(zero_copy_only=False)
            offsets -= offsets[0]
            k = 0
            while k < len(offsets) - 1:
                to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + GATHER, side="right")) - 1)
                n = number[offsets[k] : offsets[to]]
                size = length[n]
                found = ids[_places(first[n], size)]
                cuts = np.concatenate([[0], np.cumsum(size)])[offsets[k : to + 1] - offsets[k]].tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield found[a:b]
                k = to
            done = upto

    def ids(self, text: str) -> np.ndarray:
        return next(self.encode(pa.array([text])))


def _strings(found: pa.Array) -> list[str]:
    """As to_pylist(), without a scalar for each."""
    return found.to_numpy(zero_copy_only=False).tolist()


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _term_hashes(terms: np.ndarray) -> np.ndarray:
    h = terms.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(32)).astype(np.uint32)


#: Hashes of the smaller ids, so that they need not be worked out document by document.
_HASHES = _term_hashes(np.arange(1 << 16))


def routing_key(terms: np.ndarray) -> bytes:
    """The least hashes of a document's distinct terms (in order), in order, as bytes that sort the same way."""
    h = _HASHES[terms] if not len(terms) or terms[-1] < len(_HASHES) else _term_hashes(terms)
    if len(h) > KEY_TERMS:
        h = np.partition(h, KEY_TERMS - 1)[:KEY_TERMS]
    return np.sort(h).astype(">u4").tobytes()


@dataclass
class Statistics:
    """What BM25 needs to know of all documents: their number, their tokens, and in how many of them each term lies."""

    n_docs: int
    n_tokens: int
    df: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        terms = np.concatenate([np.unique(ids) for ids in docs])
        return cls(len(docs), sum(map(len, docs)), np.bincount(terms))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        """Terms in more than half of the documents carry no weight."""
        df = self.df[terms]
        return np.maximum(0.0, np.log((self.n_docs - df + 0.5) / (df + 0.5)))


class ShardIndex:
    """BM25 over the documents of a shard with the statistics of the corpus, or of the shard where none are given."""

    def __init__(self, docs: list[np.ndarray], corpus: Statistics | None = None):
        corpus = corpus or Statistics.of(docs)
        terms, counts, owners = [], [], []
        self.terms = []
        for k, ids in enumerate(docs):
            t, n = np.unique(ids, return_counts=True)
            self.terms.append(t)
            terms.append(t)
            counts.append(n)
            owners.append(np.full(len(t), k, dtype=np.int32))
        term, tf, owner = np.concatenate(terms), np.concatenate(counts), np.concatenate(owners)
        order = np.argsort(term, kind="stable")
        term, tf, self.owner = term[order], tf[order], owner[order]
        self.vocabulary, self.first = np.unique(term, return_index=True)
        df = np.diff(np.append(self.first, len(term)))
        self.last = self.first + df
        idf = corpus.idf(self.vocabulary)
        length = np.array([max(1, len(x)) for x in docs], dtype=float)
        norm = K1 * (1 - B + B * length * corpus.n_docs / max(1, corpus.n_tokens))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.owner])
        self.useful = idf > 0
        self.unused = np.ones(len(docs), dtype=bool)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Score of every document of the shard for a query of distinct terms; used ones are at -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        at = at[(self.vocabulary[at] == terms) & self.useful[at]]
        sizes = self.last[at] - self.first[at]
        total = int(sizes.sum())
        found = np.zeros(len(self.unused))
        if total:
            begins = np.repeat(self.first[at] - np.cumsum(sizes) + sizes, sizes)
            rows = begins + np.arange(total)
            found = np.bincount(self.owner[rows], weights=self.weight[rows], minlength=len(self.unused))
        return np.where(self.unused, found, -1.0)


@dataclass
class Packer:
    """Fills windows in order; rows holds the pieces of full windows, pending those of the open one."""

    first_sequence: int
    window: int = WINDOW
    with_ids: bool = False
    sequence: int = 0
    fill: int = 0
    seed: np.ndarray | None = None
    rows: list[tuple] = field(default_factory=list)
    pending: list[tuple] = field(default_factory=list)

    def place(self, doc_id: int | None, ids: np.ndarray, terms: np.ndarray) -> bool:
        """Put a whole document; true if it closed a window or opened one, so that another seed is in charge."""
        start, moved = 0, self.fill == 0
        if moved:
            self.seed = terms
        while start < len(ids):
            n = min(self.window - self.fill, len(ids) - start)
            self.pending.append((doc_id, start, ids[start : start + n], len(ids)))
            start, self.fill = start + n, self.fill + n
            if self.fill == self.window:
                self._close(self.window)
                self.seed, moved = terms, True
        return moved

    def _close(self, size: int) -> None:
        """A sequence of the first `size` pending ids, which need no padding."""
        offset, pending, self.pending = 0, self.pending, []
        for doc_id, start, part, total in pending:
            n = min(len(part), size - offset)
            if n:
                head = part[:n]
                self.rows.append((doc_id, start, n, zlib.crc32(head.astype("<u4", copy=False)), total, self.first_sequence + self.sequence, offset, size, head if self.with_ids else None))
            if n < len(part):
                self.pending.append((doc_id, start + n, part[n:], total))
            offset += n
        self.sequence, self.fill = self.sequence + 1, self.fill - size

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two, the longest first."""
        while self.fill:
            self._close(1 << self.fill.bit_length() - 1)

    def shard(self, names: list[int | None], docs: list[np.ndarray], corpus: Statistics | None = None) -> None:
        index = ShardIndex(docs, corpus)
        scores, nxt = None, 0
        for _ in docs:
            if scores is None and self.fill:
                scores = index.scores(self.seed)
            if self.fill:
                k = int(scores.argmax())
                if scores[k] <= 0:
                    scores[k] = -1.0
                    k = int(index.unused.argmax())
            else:
                while not index.unused[nxt]:
                    nxt += 1
                k = nxt
            index.unused[k] = False
            if scores is not None:
                scores[k] = -1.0
            if self.place(names[k], docs[k], index.terms[k]):
                scores = None

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * 9
        self.rows = []
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names=names)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(id, pos, n, key, ids) for every row of docs of (id, text), and one row of counts for every task that had rows.

    ids are little-endian, two bytes each where a document's fit, else four. A row of counts has pos -1, the number of
    documents as id and that of tokens as n, the distinct terms as key and their document frequencies as ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer)
        end = np.array([end_id], dtype="<u4")
        first, n_docs, n_tokens, df = TaskContext.get().partitionId() << 40, 0, 0, np.zeros(1 << 16, dtype=np.int64)
        kinds, names = [pa.int64()] * 3 + [pa.binary()] * 2, ["id", "pos", "n", "key", "ids"]
        rows = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)
        for b in batches:
            sizes, keys, held = [], [], []
            for own in pieces.encode(b.column(1)):
                terms = np.unique(own)
                largest = max(int(terms.max(initial=0)), end_id)
                if largest >= len(df):
                    df = np.append(df, np.zeros(largest + 1 - len(df), dtype=np.int64))
                df[terms] += 1
                keys.append(routing_key(terms))
                sizes.append(len(own) + 1)
                held.append(np.concatenate([own, end]).astype("<u2" if largest < 1 << 16 else "<u4").tobytes())
            yield rows([b.column(0), range(first + n_docs, first + n_docs + len(sizes)), sizes, keys, held])
            n_docs, n_tokens = n_docs + len(sizes), n_tokens + sum(sizes)
        if n_docs:
            df[end_id] = n_docs  # every document ends with it
            terms = np.flatnonzero(df)
            yield rows([[n_docs], [-1], [n_tokens], [terms.astype("<i8").tobytes()], [df[terms].astype("<i8").tobytes()]])
        release_memory()

    return docs.mapInArrow(run, "id long, pos long, n long, key binary, ids binary")


def statistics(rows: DataFrame) -> Statistics:
    """Statistics of all documents from a table of tokenized(); the driver gets one row a distinct term."""
    counts = rows.where("pos < 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, df in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (terms, df)], names=["term", "df"])

    total = counts.agg(F.sum("id").alias("docs"), F.sum("n").alias("tokens")).first()
    found = counts.select("key", "ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = found["term"].to_numpy(), found["df"].to_numpy()
    dense = np.zeros(int(term.max(initial=0)) + 1, dtype=np.int64)
    dense[term] = df
    return Statistics(total["docs"] or 0, total["tokens"] or 0, dense)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """Pack every row of docs into windows of `window` ids; one row per piece.

    tokenizer: path of a tokenizers file that the executors have. A document is its ids followed by end_id; null and
    empty texts are end_id alone. Rows with null or repeated ids are documents of their own. Every id lies in exactly
    one piece; a sequence is filled from offset 0 without gaps and holds padded_length ids: the window, or a power of
    two where a task ends. text_ids is null unless with_ids. An empty table gives an empty result. Other columns are
    not looked at. Tokenizing and counting run at once, the packing when the result is read; bounds of its ranges are
    drawn by Spark from a sample, so that reading the result of a large table twice may pack it differently.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch(tokenized(chosen, tokenizer, end_id), "packing-ids")
    corpus = statistics(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, window, with_ids)
        names, held, size = [], [], 0
        for b in batches:
            for name, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = ids.as_py()
                held.append(np.frombuffer(found, "<u2" if len(found) == 2 * n else "<u4").astype("<u4"))
                names.append(name)
                size += n
                if len(held) >= shard_docs or size >= SHARD_TOKENS:
                    packer.shard(names, held, corpus)
                    names, held, size = [], [], 0
                    yield packer.drain()
        if held:
            packer.shard(names, held, corpus)
        packer.finish()
        yield packer.drain()
        release_memory()

    # long documents have small hashes and gather in few ranges: many ranges keep the largest small
    ranges = max(1, -(-corpus.n_tokens // SHARD_TOKENS))
    routed = rows.where("pos >= 0").repartitionByRange(ranges, "key", "pos").sortWithinPartitions("key", "pos")
    return routed.select("id", "n", "ids").mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).withColumnRenamed("id", "doc_id").drop("text_ids")
