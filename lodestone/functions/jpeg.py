"""Baseline JPEG to RGB: Huffman-coded, 8 bits, one or three components, any sampling. Progressive files are refused."""

from __future__ import annotations

import re
import struct

import numpy as np

#: Row-major places of the coefficients in the order of the zigzag: diagonal by diagonal, in turns up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_WAVE = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code matches."""
    found, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            span = 1 << (16 - length)
            found[code * span : (code + 1) * span] = [(length, symbol)] * span
            code += 1
        at, code = at + n, code << 1
    return found[:65536]


class _Bits:
    """Bits of entropy-coded bytes, ones behind the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        part += b"\xff" * (8 - len(part))
        self.held, self.n = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(part), self.n + 64

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._fill()
        length, symbol = table[self.held >> (self.n - 16) & 0xFFFF]
        if not length:
            raise ValueError("broken Huffman code")
        self.n -= length
        return symbol

    def number(self, size: int) -> int:
        """A signed number of `size` bits: those with a leading 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self._fill()
        self.n -= size
        x = self.held >> self.n & ((1 << size) - 1)
        return x if x >> (size - 1) else x - (1 << size) + 1


def decode_jpeg(data: bytes) -> np.ndarray:
    """rows x columns x 3 bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant, huffman, frame, restart, adobe, at = {}, {}, None, 0, None, 2
    while True:
        at = data.index(b"\xff", at)
        while data[at] == 0xFF:
            at += 1
        kind, at = data[at], at + 1
        if kind == 0xD9:
            raise ValueError("no image data")
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            continue
        size = struct.unpack(">H", data[at : at + 2])[0]
        body, at = data[at + 2 : at + size], at + size
        if kind == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(float)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                huffman[body[0]] = _table(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("unsupported kind of JPEG")
            frame = height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("unsupported kind of JPEG: not baseline")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            break
    if frame is None or body[0] != len(frame[2]):
        raise ValueError("unsupported kind of JPEG: several scans")
    height, width, parts = frame
    tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if len(parts) == 1:  # a single component's blocks come one by one, whatever its sampling
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if any(across % p[1] or down % p[2] for p in parts):
        raise ValueError("unsupported kind of JPEG: sampling")
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
    segments = re.split(rb"\xff+[\xd0-\xd7]", data[at : end.start() if end else len(data)])
    blocks = [np.zeros((rows * p[2], columns * p[1], 64)) for p in parts]
    bits, last = None, []
    for mcu in range(rows * columns):
        if bits is None or (restart and mcu % restart == 0):
            n = mcu // restart if restart else 0
            bits, last = _Bits((segments[n] if n < len(segments) else b"").replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        y, x = divmod(mcu, columns)
        for k, (name, h, v, _) in enumerate(parts):
            dc, ac = huffman[tables[name] >> 4], huffman[16 | tables[name] & 15]
            for sub in range(h * v):
                block = blocks[k][y * v + sub // h, x * h + sub % h]
                last[k] += bits.number(bits.symbol(dc))
                block[0], place = last[k], 1
                while place < 64:
                    symbol = bits.symbol(ac)
                    run, size = symbol >> 4, symbol & 15
                    if not size and run < 15:
                        break
                    place += run
                    if size and place < 64:
                        block[place] = bits.number(size)
                    place += 1
    planes = []
    for found, (_, h, v, name) in zip(blocks, parts, strict=True):
        square = np.zeros(found.shape)
        square[..., ZIGZAG] = found * quant[name]
        square = _WAVE.T @ square.reshape(*found.shape[:2], 8, 8) @ _WAVE
        plane = square.transpose(0, 2, 1, 3).reshape(found.shape[0] * 8, found.shape[1] * 8) + 128
        planes.append(np.repeat(np.repeat(plane, down // v, axis=0), across // h, axis=1)[:height, :width])
    if len(planes) == 1:
        planes *= 3
    elif adobe != 0:  # luminance and two colour differences
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - (0.299 * 1.402 * r + 0.114 * 1.772 * b) / 0.587, y + 1.772 * b]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)
