"""PDF text and JPEG pixels, on files that are made here."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import images, jpeg
from lodestone.sources import files, pdf

CMAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00480065> <0002> <006C> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <4F60>] endbfrange endcmap"


def make(contents, packed=False, fonts=b"<< /F1 5 0 R /F2 6 0 R >>", extra=()):
    """A PDF with a page per content stream, one of them nested in the page tree; packed: pages in an object stream."""
    out, n = [b"%PDF-1.5\n%\xe2\xe3\n"], len(contents)
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ 10 0 R 3 0 R ] /Count %d /Resources << /Font %s /XObject << /Fm 8 0 R >> >> >>" % (n, fonts)}
    plain[3] = b"<< /Type /Pages /Parent 2 0 R /Kids [" + b" ".join(b"%d 0 R" % (10 + k) for k in range(1, n)) + b"] >>"
    plain[5] = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [ 1 /eacute /A /fi /uni20AC ] >> >>"
    plain[6] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"
    for k in range(n):
        plain[10 + k] = b"<< /Type /Page /Parent 2 0 R /Contents %s >>" % (b"[ %d 0 R %d 0 R ]" % (30 + k, 60) if k == 0 else b"%d 0 R" % (30 + k))
    plain |= dict(extra)
    stream = lambda head, data: b"<< " + head + b" /Length %d >>\nstream\r\n" % len(data) + data + b"\nendstream"
    streams = {7: (b"/Filter /FlateDecode", zlib.compress(CMAP)), 8: (b"/Type /XObject /Subtype /Form", b"BT /F1 9 Tf 1 0 0 1 0 5 Tm (in a form) Tj ET"), 60: (b"", b"")}
    for k, c in enumerate(contents):
        streams[30 + k] = (b"/Filter /FlateDecode", zlib.compress(c)) if k % 2 else (b"/Filter [ /ASCIIHexDecode ]", c.hex().encode() + b">")
    if packed:
        body, places = b"", []
        for number, data in plain.items():
            places.append(b"%d %d" % (number, len(body)))
            body += data + b" "
        head = b" ".join(places) + b" "
        streams[90] = (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(plain), len(head)), zlib.compress(head + body))
        streams[91] = (b"/Type /XRef /Root 1 0 R", b"")
        plain = {}
    for number, data in plain.items():
        out.append(b"%d 0 obj\n" % number + data + b"\nendobj\n")
    for number, (head, data) in streams.items():
        out.append(b"%d 0 obj " % number + stream(head, data) + b" endobj\n")
    return b"".join(out) + (b"" if packed else b"trailer << /Root 1 0 R >>\n") + b"%%EOF"


PAGES = [
    rb"BT /F1 12 Tf 50 700 Td (First line \(of two\)) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ ET",
    rb"BT /F1 12 Tf 14 TL 1 0 0 1 50 700 Tm <48656C6C6F> Tj 40 0 Td (there) Tj T* (caf\351 \001\002\003\004) Tj (quoted) ' ET",
    rb"BT /F2 12 Tf 9 9 Td <000100020002> Tj <0010001100120020> Tj <0021> Tj ET q /Fm Do Q BI /W 1 /H 1 ID \x00(no text) Tj\xff EI",
    b"",
]
TEXTS = ["First line (of two)\nSecond line", "Hello there\ncaf\u00e9 \u00e9Afi\u20ac\nquoted", "Hellabc\u00e9\u4f60\nin a form", ""]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    assert pdf.pages(make(PAGES, packed)) == TEXTS


def test_pdf_changed_later_and_broken():
    data = make(PAGES[:2])
    newer = b"31 0 obj << /Length 99 0 R >> stream\nBT /F1 1 Tf (newer) Tj ET\nendstream endobj 99 0 obj 27 endobj\n"
    assert pdf.pages(data + newer) == [TEXTS[0], "newer"]
    for bad in (b"%PDF", b"", b"%PDF-1.4 1 0 obj << /Type /Catalog >> endobj", data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")):
        with pytest.raises(ValueError):
            pdf.pages(bad)
    loop = make(PAGES[:2], extra={3: b"<< /Type /Pages /Kids [ 2 0 R 3 0 R 11 0 R ] >>"}.items())
    assert pdf.pages(loop) == TEXTS[:2]
    r = random.Random(1)
    for _ in range(300):  # damaged files end, in a text or in an exception
        at = r.randrange(len(data))
        try:
            pdf.pages(data[:at] + bytes([r.randrange(256)]) + data[at + r.randrange(3) :])
        except Exception as e:
            assert isinstance(e, (ValueError, zlib.error, TypeError, KeyError, AttributeError, EOFError, IndexError, RecursionError)), e


def test_pdf_in_a_batch(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(make(PAGES))), ("b.PDF", bytearray(b"junk")), ("c.txt", bytearray(b"plain"))], "path string, content binary")
    got = {r.path: r for r in files.parse(df).collect()}
    assert (got["a.pdf"].page_count, got["a.pdf"].extracted_text) == (4, "".join(f"{t}\n" for t in TEXTS))
    assert got["b.PDF"].error_code == files.ERR_CRASH and got["c.txt"].extracted_text == "plain"


def encode(image, sampling=(1, 1), restart=0, adobe=None):
    """A baseline JPEG with quantisation by 1 and codes of one length, so that pixels come back nearly as they were."""
    h, w, n = image.shape
    planes = [image[..., k].astype(float) for k in range(n)]
    if n == 3 and adobe is None:
        r, g, b = planes
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    sx, sy = sampling if n == 3 else (1, 1)
    columns, rows = -(-w // (8 * sx)), -(-h // (8 * sy))
    planes = [np.pad(p, ((0, rows * 8 * sy - h), (0, columns * 8 * sx - w)), mode="edge") for p in planes]
    planes = [planes[0], *[p.reshape(rows * 8, sy, columns * 8, sx).mean(axis=(1, 3)) for p in planes[1:]]]
    seg = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    symbols = bytes(range(12)), bytes(16 * r + s for r in range(16) for s in range(11))
    out = b"\xff\xd8" + (seg(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe])) if adobe is not None else b"")
    out += seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, (sx << 4 | sy) if k == 0 else 0x11, 0]) for k in range(n)))
    out += seg(0xC4, b"\0" + bytes([0] * 3 + [12] + [0] * 12) + symbols[0]) + seg(0xC4, b"\x10" + bytes([0] * 7 + [176] + [0] * 8) + symbols[1])
    out += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0")
    bits, last, scan, mark = "", [0] * n, b"", 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    def number(x, size):
        return format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    for mcu in range(rows * columns):
        if restart and mcu and mcu % restart == 0:
            scan += flush() + b"\xff" + bytes([0xD0 + mark % 8])
            mark, last = mark + 1, [0] * n
        for k in range(n):
            a, b = (sx, sy) if k == 0 else (1, 1)
            for sub in range(a * b):
                y, x = (mcu // columns * b + sub // a) * 8, (mcu % columns * a + sub % a) * 8
                c = np.rint(jpeg._WAVE @ (planes[k][y : y + 8, x : x + 8] - 128) @ jpeg._WAVE.T).astype(int).ravel()[jpeg.ZIGZAG].tolist()
                size = abs(c[0] - last[k]).bit_length()
                bits += format(size, "04b") + number(c[0] - last[k], size)
                last[k], run = c[0], 0
                for v in c[1:]:
                    if v:
                        while run > 15:
                            bits, run = bits + format(symbols[1].index(0xF0), "08b"), run - 16
                        size = abs(v).bit_length()
                        bits, run = bits + format(symbols[1].index(run << 4 | size), "08b") + number(v, size), 0
                    else:
                        run += 1
                bits += format(0, "08b") if run else ""
    return out + scan + flush() + b"\xff\xd9"


def test_jpeg():
    r = np.random.default_rng(1)
    noise = r.integers(0, 256, (21, 30, 3))
    smooth = np.stack([np.add.outer(np.arange(37) * 3, np.arange(50) * 2), np.full((37, 50), 90), np.add.outer(np.arange(37), np.arange(50))], axis=2) % 256
    grey = r.integers(0, 256, (9, 17, 1))
    for image in (noise, smooth):
        for restart in (0, 3):
            got = jpeg.decode_jpeg(encode(image, restart=restart)).astype(int)
            assert got.shape == image.shape and np.abs(got - image).max() <= 4
    assert np.abs(jpeg.decode_jpeg(encode(grey)).astype(int) - grey).max() <= 2
    assert np.abs(jpeg.decode_jpeg(encode(noise, adobe=0)).astype(int) - noise).max() <= 3
    shades = np.repeat(r.integers(0, 256, (40, 36, 1)), 3, axis=2)  # colour differences are flat, so sampling loses nothing
    for sampling in ((2, 2), (2, 1), (1, 2)):
        assert np.abs(jpeg.decode_jpeg(encode(shades, sampling, restart=2)).astype(int) - shades).max() <= 4
    data = encode(noise)
    for bad in (b"", b"\xff\xd8\xff\xd9", data.replace(b"\xff\xc0", b"\xff\xc2"), data[:40]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            jpeg.decode_jpeg(bad)


def test_jpeg_tensors(spark):
    image = np.full((16, 16, 3), (200, 30, 90))
    df = spark.createDataFrame([("a.jpg", bytearray(encode(image))), ("b.jpg", bytearray(b"\xff\xd8junk"))], "path string, content binary")
    got = {x.id: x for x in images.image_tensors(df).select("id", "ok", F.size("tensor").alias("n"), F.slice("tensor", 1, 3).alias("t")).collect()}
    assert got["a.jpg"].n == 224 * 224 * 3 and np.abs(np.array(got["a.jpg"].t) * 255 - image[0, 0]).max() <= 2 and not got["b.jpg"].ok
