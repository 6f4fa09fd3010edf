"""Embedding hooks: models are given by the caller and loaded once per Python worker task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Error codes of a failed embedding.
ERR_INPUT, ERR_INFERENCE = "ERR_INVALID_INPUT", "ERR_INFERENCE_FAILED"

#: Takes texts or image bytes, returns one vector each.
Encode = Callable[[list], np.ndarray]
RESULT = "task_id string, ok boolean, vector array<float>, error_code string, error_message string"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


@dataclass(frozen=True)
class HashingEmbedder:
    """Stands in for a model: signed token hashes summed up; deterministic, unit length (zero for no tokens)."""

    dim: int
    normalize: bool = True

    def __call__(self, items: list) -> np.ndarray:
        out = np.zeros((len(items), self.dim))
        for row, item in enumerate(items):
            tokens = re.findall(r"\w+", item.lower()) if isinstance(item, str) else [bytes(item[at : at + 64]).hex() for at in range(0, len(item), 64)]
            for t in tokens:
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dim] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1) if self.normalize else out


@dataclass(frozen=True)
class LetterCounts:
    """A stand-in that can be checked by eye: how often each of a to z occurs."""

    def __call__(self, items: list) -> np.ndarray:
        return np.array([[item.count(chr(c) if isinstance(item, str) else bytes([c])) for c in range(97, 123)] for item in items], dtype=float)


@dataclass
class EmbeddingEngine:
    """Three spaces' encoders: load functions, called once per task, so that models live on the executors.

    text: 768 components, as the model returns them. multimodal_text: 512, checked finite and scaled to unit length.
    image: 512, as the model returns them.
    """

    text: Callable[[], Encode] = lambda: HashingEmbedder(768, normalize=False)
    multimodal_text: Callable[[], Encode] = lambda: HashingEmbedder(512)
    image: Callable[[], Encode] = lambda: HashingEmbedder(512)
    at_once: int = 32
    #: Type of the components: float as models have them, or double where a result is computed with.
    component: str = "float"

    def batch(self, tasks: DataFrame) -> DataFrame:
        """Embed (task_id, mode, text, image) rows; mode: text, multimodal_text or image. A task's failure is its row.

        A model gets up to `at_once` items of one mode at a time; if that call fails, its items one by one. A Python
        worker makes one call at a time, so the calls in flight on an executor are at most its task slots.
        """
        loaders, at_once = {"text": self.text, "multimodal_text": self.multimodal_text, "image": self.image}, self.at_once
        kind = {"float": np.float32, "double": np.float64}[self.component]

        def finished(mode: str, v) -> dict:
            v = np.asarray(v, dtype=np.float64)
            if mode == "multimodal_text":
                norm = float(np.sqrt((v * v).sum()))
                if not np.isfinite(v).all() or norm == 0:
                    raise ValueError("vector is zero or not finite")
                v = v / norm
            return {"ok": True, "vector": v.astype(kind).tolist()}

        def attempt(encode: Encode, mode: str, items: list) -> list[dict]:
            try:
                found = encode(items)
                if len(found) != len(items):
                    raise ValueError(f"{len(found)} vectors for {len(items)} inputs")
            except Exception as e:  # a task's failure is its own row
                if len(items) == 1:
                    return [{"ok": False, "error_code": ERR_INFERENCE, "error_message": str(e)}]
                return [attempt(encode, mode, [x])[0] for x in items]
            out = []
            for v in found:
                try:
                    out.append(finished(mode, v))
                except Exception as e:
                    out.append({"ok": False, "error_code": ERR_INFERENCE, "error_message": str(e)})
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded: dict[str, Encode] = {}
            for pdf in batches:
                modes, items = pdf["mode"].tolist(), [i if m == "image" else t for m, t, i in zip(pdf["mode"], pdf["text"], pdf["image"], strict=True)]
                rows: list[dict] = [{}] * len(pdf)
                for mode in dict.fromkeys(modes):
                    own = [k for k, m in enumerate(modes) if m == mode]
                    if mode not in loaders:
                        for k in own:
                            rows[k] = {"ok": False, "error_code": ERR_INPUT, "error_message": f"unknown mode {mode}"}
                        continue
                    empty = [k for k in own if items[k] is None or len(items[k]) == 0]
                    for k in empty:
                        rows[k] = {"ok": False, "error_code": ERR_INPUT, "error_message": f"no input for mode {mode}"}
                    full = sorted({*own} - {*empty})
                    if full and mode not in loaded:
                        loaded[mode] = loaders[mode]()
                    for at in range(0, len(full), at_once):
                        part = full[at : at + at_once]
                        for k, row in zip(part, attempt(loaded[mode], mode, [items[k] for k in part]), strict=True):
                            rows[k] = row
                rows = [dict.fromkeys(RESULT_COLUMNS) | {"task_id": t} | r for t, r in zip(pdf["task_id"], rows, strict=True)]
                yield pd.DataFrame(rows, columns=RESULT_COLUMNS, dtype=object)

        return tasks.select("task_id", "mode", "text", "image").mapInPandas(run, RESULT.replace("array<float>", f"array<{self.component}>"))
