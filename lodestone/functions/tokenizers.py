"""WordPiece and byte-pair encoding as Arrow UDFs over vocabularies given by the caller."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basic_tokens, clip_pieces, pad_ids

# Special tokens and sizes.
UNK, CLS, SEP, PAD = "[UNK]", "[CLS]", "[SEP]", "[PAD]"
CONTEXT_BERT, CONTEXT_CLIP = 128, 77
CLIP_VOCABULARY, CLIP_MERGES = 49408, 48894


def load_vocabulary(path: str) -> dict[str, int]:
    """Token of each line with its line number, from 0."""
    with open(path, encoding="utf-8") as f:
        return {line.rstrip("\n"): n for n, line in enumerate(f)}


def word_pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    """Longest known pieces from the left, later ones marked ##; one unknown part makes the word [UNK]."""
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [UNK]
        out.append(mark + word[at:end])
        at = end
    return out


def bert_pieces(text: Column, vocabulary: dict[str, int]) -> Column:
    """array<string> of word pieces."""

    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        pieces = lru_cache(maxsize=200_000)(lambda w: word_pieces(w, vocabulary))
        return words.map(lambda ws: None if ws is None else [p for w in ws for p in pieces(w)])

    return run(basic_tokens(text))


def bert_input(text: Column, vocabulary: dict[str, int], length: int = CONTEXT_BERT) -> Column:
    """struct(input_ids, attention_mask, token_type_ids) with [CLS], the first length-2 pieces, [SEP] and padding."""
    unknown = vocabulary[UNK]

    @F.pandas_udf("array<int>")
    def ids(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda ps: None if ps is None else [vocabulary.get(p, unknown) for p in ps])

    return pad_ids(ids(bert_pieces(text, vocabulary)), vocabulary[CLS], vocabulary[SEP], vocabulary.get(PAD, 0), length)


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else the next free one from 256 up."""
    printing = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in printing else chr(next(free)) for b in range(256)}


class ClipTokenizer:
    """Byte-pair encoder with word ends; merges: pairs in order of rank."""

    def __init__(self, merges: list[tuple[str, str]]):
        letters = byte_letters()
        order = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        order += [b for b in range(256) if b not in order]
        singles = [letters[b] for b in order]
        names = [*singles, *[f"{s}</w>" for s in singles], *[a + b for a, b in merges], "<start_of_text>", "<end_of_text>"]
        self.ids = {t: n for n, t in enumerate(names)}
        self.rank = {pair: n for n, pair in enumerate(merges)}
        self.letters = letters
        self.start, self.end = len(names) - 2, len(names) - 1
        self.known: dict[str, tuple[str, ...]] = {}

    @classmethod
    def from_merges_file(cls, path: str, strict: bool = True) -> ClipTokenizer:
        """Lines of two symbols; # lines and others are skipped. strict: exactly as many as the vocabulary needs."""
        with open(path, encoding="utf-8") as f:
            pairs = [tuple(x) for line in f if not line.startswith("#") and len(x := line.split()) == 2]
        if strict and len(pairs) < CLIP_MERGES:
            raise ValueError(f"{len(pairs)} merges; {CLIP_MERGES} are needed")
        return cls(pairs[:CLIP_MERGES])

    def symbols(self, piece: str) -> tuple[str, ...]:
        """Merged symbols of one piece: the pair of lowest rank first, all its occurrences, until none is left."""
        if piece in self.known:
            return self.known[piece]
        word = [self.letters[b] for b in piece.encode("utf-8")]
        word[-1] += "</w>"
        while len(word) > 1:
            best = min(zip(word, word[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            out, at = [], 0
            while at < len(word):
                if tuple(word[at : at + 2]) == best:
                    out.append(word[at] + word[at + 1])
                    at += 2
                else:
                    out.append(word[at])
                    at += 1
            word = out
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[piece] = tuple(word)
        return self.known[piece]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        special = {"<start_of_text>": self.start, "<end_of_text>": self.end}
        return [i for p in pieces for i in ([special[p]] if p in special else [self.ids[s] for s in self.symbols(p)])]

    def frame(self, ids: list[int], length: int = CONTEXT_CLIP) -> list[int]:
        """Start, the first length-2 ids, end, zeros up to length."""
        if length < 2:
            raise ValueError("length must be at least 2")
        kept = [self.start, *ids[: length - 2], self.end]
        return kept + [0] * (length - len(kept))

    def encode(self, text: Column, length: int = CONTEXT_CLIP) -> Column:
        """array<int> of `length` ids."""
        if length < 2:
            raise ValueError("length must be at least 2")
        me = self

        @F.pandas_udf("array<int>")
        def run(pieces: pd.Series) -> pd.Series:
            return pieces.map(lambda p: me.frame(me.piece_ids([] if p is None else list(p)), length))

        return run(clip_pieces(text))


def token_count(tokens: Column) -> Column:
    return F.size(tokens)


def token_to_id(token: Column, vocabulary: dict[str, int]) -> Column:
    """Id of a token, that of [UNK] where it is unknown."""

    @F.pandas_udf("int")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: vocabulary.get(t, vocabulary[UNK])).astype("int32")

    return run(token)

