"""Files to text: routing, parsing, structured errors. Every file is one row; errors are columns."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from .pdf import pages as pdf_pages

# Error codes.
ERR_NOT_FOUND, ERR_UNSUPPORTED, ERR_CRASH = "ERR_FILE_NOT_FOUND", "ERR_UNSUPPORTED_FORMAT", "ERR_ENGINE_CRASH"
# Extensions offered for scanning, and those that are images to the indexer.
SCAN_EXTENSIONS = ("txt", "pdf", "docx", "png", "jpg", "jpeg", "bmp", "webp")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".webp")

RESULT = "path string, is_success boolean, file_type string, extracted_text string, page_count int, width int, height int, error_code string, error_message string"
#: A parser takes a file's bytes and returns its text, or raises.
Parser = Callable[[bytes], str]


def file_type(path: Column) -> Column:
    """txt, pdf, docx, image (.jpg and .png only) or unknown, by suffix in any case."""
    low = F.lower(path)
    image = low.endswith(".jpg") | low.endswith(".png")
    return F.when(low.endswith(".txt"), "txt").when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").when(image, "image").otherwise("unknown")


def scannable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*SCAN_EXTENSIONS)


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processing document, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{space}p"):
        lines.append("".join("\t" if x.tag == f"{space}tab" else x.text or "" for x in p.iter() if x.tag in (f"{space}t", f"{space}tab")))
    return "\n".join(lines)


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from a PNG or JPEG header; (0, 0) if it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return 0, 0
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return 0, 0


def parse(files: DataFrame, pdf: Callable[[bytes], list[str]] | None = pdf_pages, ocr: Parser | None = None, docx: Parser = docx_text) -> DataFrame:
    """One result row per file; files: (path, content binary). A failing parser gives an error row, never an exception.

    pdf returns the pages' texts, ocr an image's text; without one such files are reported as crashes of the engine.
    """

    def one(path: str, kind: str, data: bytes) -> dict:
        row = dict.fromkeys(columns) | {"path": path, "is_success": True, "file_type": kind}
        try:
            if kind == "docx":
                row["extracted_text"] = docx(data)
            elif kind == "pdf":
                if pdf is None:
                    raise RuntimeError("no PDF parser is installed")
                pages = pdf(data)
                row |= {"page_count": len(pages), "extracted_text": "".join(f"{p}\n" for p in pages)}
            elif kind == "image":
                width, height = image_size(data)
                row |= {"width": width, "height": height}
                if ocr is None:
                    raise RuntimeError("no OCR engine is installed")
                row["extracted_text"] = ocr(data).strip()
        except Exception as e:  # a file's failure is its own row
            row |= {"is_success": False, "error_code": ERR_CRASH, "error_message": str(e)}
        return row

    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_batch in batches:
            rows = [one(*x) for x in zip(pdf_batch["path"], pdf_batch["kind"], pdf_batch["content"], strict=True)]
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            yield out.astype({"page_count": "Int32", "width": "Int32", "height": "Int32"})

    kinds = files.select("path", file_type(F.col("path")).alias("kind"), "content")
    # plain text and unknown files stay in the JVM; only documents and images go to Python
    text, none = F.col("content").cast("string"), lambda kind: F.lit(None).cast(kind)
    known, whole = F.col("kind") == "txt", F.coalesce(F.is_valid_utf8(text), F.lit(False))
    plain = kinds.where("kind in ('txt', 'unknown')").select(
        "path", (known & whole).alias("is_success"), F.col("kind").alias("file_type"), F.when(known & whole, text).alias("extracted_text"),
        none("int").alias("page_count"), none("int").alias("width"), none("int").alias("height"),
        F.when(~known, ERR_UNSUPPORTED).when(~whole, ERR_CRASH).alias("error_code"),
        F.when(~known, F.concat(F.lit("not supported: "), "path")).when(~whole, "the text is not UTF-8").alias("error_message"),
    )
    return plain.unionByName(kinds.where("kind not in ('txt', 'unknown')").mapInPandas(run, RESULT))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(position, path, exists, content, file_name, file_size, last_modified) of the paths asked for, in that order.

    Paths that do not exist stay, with exists false.
    """
    fs_path, rows = spark._jvm.org.apache.hadoop.fs.Path, []
    for n, p in enumerate(paths):
        fs = fs_path(p).getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(fs_path(p)) if fs.exists(fs_path(p)) else None
        rows.append((n, p, status is not None, status and status.getLen(), status and status.getModificationTime()))
    asked = spark.createDataFrame(rows, "position int, path string, exists boolean, file_size long, modified long")
    full = [p for _, p, _, size, _ in rows if size]  # the reader passes over files of length 0
    found = spark.read.format("binaryFile").load(full) if full else spark.createDataFrame([], "path string, content binary")
    plain = F.regexp_replace("path", "^file:/+", "/")
    joined = asked.join(found.select(plain.alias("key"), "content"), plain == F.col("key"), "left")
    content = F.when(F.col("exists"), F.coalesce("content", F.lit(b"")))
    iso = F.date_format(F.timestamp_millis("modified"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return joined.select("position", "path", "exists", content.alias("content"), base_name(F.col("path")).alias("file_name"), "file_size", iso.alias("last_modified"))


def parse_files(spark: SparkSession, paths: list[str], **parsers) -> DataFrame:
    """parse() over paths, with file metadata; a missing file is a row with its error code."""
    files = read_files(spark, paths)
    parsed = parse(files.where("exists").select("path", "content").dropDuplicates(["path"]), **parsers)
    r = files.drop("content").join(parsed, "path", "left")
    missing = ~F.col("exists")
    return r.withColumns({
        "is_success": F.coalesce("is_success", F.lit(False)),
        "file_type": F.coalesce("file_type", file_type(F.col("path"))),
        "error_code": F.when(missing, ERR_NOT_FOUND).otherwise(F.col("error_code")),
        "error_message": F.when(missing, F.concat(F.lit("not found: "), "path")).otherwise(F.col("error_message")),
    })


def batch_progress(results: DataFrame) -> DataFrame:
    """Running counts in input order: (position, path, processed_count, total_count, is_success); positions count from 0."""
    total = results.agg(F.count("*").alias("n")).scalar()
    return results.select("position", "path", (F.col("position") + 1).cast("long").alias("processed_count"), total.alias("total_count"), "is_success")
