"""Image bytes to model input: PNG and baseline JPEG; for other kinds the caller gives a decoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import decode_jpeg

# Side of the model's input, bytes a pixel by PNG colour type.
SIDE = 224
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

#: Takes image bytes, returns rows x columns x 3 bytes (RGB), or raises.
Decoder = Callable[[bytes], np.ndarray]


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG scan lines with their filters undone."""
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int32)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(0, stride, step):
                left = line[x - step : x] if x else np.zeros(step, dtype=np.int32)
                up, corner = above[x : x + step], above[x - step : x] if x else np.zeros(step, dtype=np.int32)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x : x + step] = (line[x : x + step] + guess) & 255
        elif kind:
            raise ValueError("unknown filter")
        out[y], above = line, line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """RGB of an 8-bit PNG that is not interlaced; transparency is ignored."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("unsupported kind of PNG")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    pixels = _unfilter(zlib.decompress(body), height, width * n, n).reshape(height, width, n)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if n < 3 else pixels[..., :3]


def decode_image(data: bytes) -> np.ndarray:
    """RGB of a PNG or JPEG, told apart by their first bytes."""
    return decode_jpeg(data) if data[:2] == b"\xff\xd8" else decode_png(data)


def resize(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Nearest pixels on a side x side grid; the aspect is not kept."""
    rows, columns = np.arange(side) * image.shape[0] // side, np.arange(side) * image.shape[1] // side
    return image[rows][:, columns]


def image_tensors(images: DataFrame, decode: Decoder = decode_image, side: int = SIDE, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, ok, tensor array<float> of side x side x 3 values in 0..1, rows first, error_message) of every image."""

    def one(data: bytes | None) -> tuple[bool, np.ndarray | None, str | None]:
        try:
            return True, (resize(decode(data), side) / 255.0).astype(np.float32).ravel(), None
        except Exception as e:  # an image's failure is its own row
            return False, None, f"cannot be decoded: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [one(x.as_py()) for x in part.column(1)]
                cols = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", "ok", "tensor", "error_message"])

    return images.select(F.col(id_col).alias("id"), F.col(content_col)).mapInArrow(run, "id string, ok boolean, tensor array<float>, error_message string")
