"""SimHash near-duplicates by anchor-point covering.

A fingerprint is a 64-bit majority vote over the XXH64 hashes of a text's three-word shingles. Two fingerprints that
differ in at most three bits agree, up to one bit, in one of their two 32-bit halves. The anchors of a half are the
codewords of a covering code: the [31,26] Hamming code (every word lies within one bit of exactly one codeword) with the
32nd bit appended as it stands, so 2**27 anchors of covering radius 1. A fingerprint lives at its own anchor and is also
sent to every anchor within radius + threshold = 2 bits of its half, which are at most 17. If two fingerprints agree up
to one bit in a half, one is sent to the anchor at which the other lives: no link can be missed. At an anchor the
residents are compared with those sent there, over all 64 bits.

Dense groups: fingerprints with the same half on one side and the same anchor on the other differ in two bits at most,
so they are linked to the least of them without any comparison. After that only pairs whose groups still differ are
returned by the comparison; the output stays linear in a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, join_counted, release_memory, scratch, whole_row
from .components import connected_components

SEED = 42


def fingerprint_of(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text; no words give zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = [b" ".join(x) for x in zip(found, found[1:], found[2:], strict=False)] or [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fp long) for every row of docs; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_py()) for t in b.column(b.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=names)
        release_memory()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).cast("string").alias("text"))
    schema = chosen.drop("text").schema.add("fp", "long")
    names = schema.names
    return chosen.mapInArrow(run, schema)


#: Parity masks of the [31,26] Hamming code: bit position p in 1..31 counts in mask j if bit j of p is set.
MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _syndrome(half: Column) -> Column:
    s = F.lit(0)
    for j, mask in enumerate(MASKS):
        s = s.bitwiseOR(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(1), j))
    return s


#: For each syndrome the bit masks that lead to codewords within two bits: the nearest first.
REACH = [
    [0, 1 << 31]
    if s == 0
    else [1 << (s - 1), 1 << (s - 1) | 1 << 31]
    + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < (i ^ s)]
    for s in range(32)
]


def _halves(fps: DataFrame) -> DataFrame:
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    fps = fps.withColumns({"h0": low, "h1": high})
    nearest = F.array(*[F.lit(row[0]).cast("long") for row in REACH])
    return fps.withColumns({f"a{k}": F.col(f"h{k}").bitwiseXOR(F.get(nearest, _syndrome(F.col(f"h{k}")))) for k in (0, 1)})


def group_fingerprints(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Groups of distinct fingerprints under links of at most max_bits differing bits.

    fps: one row per distinct fingerprint: (fp long, rep long), rep an id that stands for it, all different, not null.
    Returns (rep long, component long) for every rep that is not the smallest of its group.
    max_bits may be at most 3, which is what the anchors cover.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the anchors cover links of at most 3 bits")
    n = fps.count()
    fps = scratch(_halves(fps.select("fp", "rep")), "fingerprints", n)
    if max_bits >= 2:  # same half here, same anchor there: at most two bits apart
        near = None
        for k in (0, 1):
            least = fps.groupBy(f"h{k}", f"a{1 - k}").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v <> top")
            part = fps.join(least, [f"h{k}", f"a{1 - k}"]).select(F.col("rep").alias("u"), "v").where("u <> v")
            near = part if near is None else near.unionByName(part)
        grown = connected_components(near)
        fps = fps.join(grown, fps["rep"] == grown["node"], "left").select("fp", "rep", "h0", "h1", "a0", "a1", F.coalesce("component", "rep").alias("part"))
        fps = scratch(fps, "parts", n)
    else:
        fps = fps.withColumn("part", F.col("rep"))
    reach = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in REACH])
    home = living = None
    for k in (0, 1):
        half = F.col(f"h{k}")
        lives = fps.select(F.lit(k).alias("side"), F.col(f"a{k}").alias("anchor"), "fp", "part")
        sent = fps.select(F.lit(k).alias("side"), F.explode(F.get(reach, _syndrome(half))).alias("m"), half.alias("h"), F.col("fp").alias("fp2"), F.col("part").alias("part2"))
        sent = sent.select("side", F.col("h").bitwiseXOR(F.col("m")).alias("anchor"), "fp2", "part2")
        home, living = (sent, lives) if home is None else (home.unionByName(sent), living.unionByName(lives))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    met = living.join(home, ["side", "anchor"]).where((F.col("fp") < F.col("fp2")) & (F.col("part") != F.col("part2")) & (apart <= max_bits))
    links = met.select(F.col("part").alias("u"), F.col("part2").alias("v"))
    if max_bits >= 2:
        links = links.unionByName(fps.where("part <> rep").select(F.col("rep").alias("u"), F.col("part").alias("v")))
    return connected_components(links).select(F.col("node").alias("rep"), "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """Near-duplicate groups of documents.

    Returns one row per input row: (id long, fp long, component long): component is the smallest id of the group.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id get their group's
    component (null if the group has no id at all). Repeated rows and ids keep one result row each. An empty table
    gives an empty result. Other columns of docs are not looked at.
    """
    fps = scratch(fingerprints(docs, id_col, text_col), "doc-fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # an id may occur under several fingerprints: a representative must be one fingerprint's own, hence ranks by fp
    n = fps.count()
    reps = scratch(reps.withColumn("rep", F.coalesce("least", F.lit(NULL_ID))), "representatives", n)
    clash = reps.groupBy("rep").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where("n > 1")
    if clash.isEmpty():
        found = group_fingerprints(reps, max_bits)
        moved = reps.join(found, "rep").select("fp", "component")
    else:  # repeated or null ids: number the fingerprints themselves, then take the smallest id of each group
        found = group_fingerprints(reps.select("fp", F.col("fp").alias("rep")), max_bits)
        own = reps.join(found.withColumnRenamed("rep", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("g"))
        least = own.groupBy("g").agg(F.min("least").alias("component"))
        moved = own.join(least, "g").select("fp", "component")
    known = reps.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n")
    return join_counted(fps, scratch(known, "groups", n), ["fp"]).select("id", "fp", "component")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: the smallest id, null ids last; of rows alike in id
    and text one (the one with the least hash of its values). Columns may have any names.
    """
    key, row = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__row")
    keyed = docs.select(key, row, whole_row(docs).alias("doc"))
    fps = scratch(fingerprints(docs.select(key, row, F.col(text_col).alias("text")), "__id", "text", ("__row",)), "doc-fingerprints")
    n = fps.count()
    reps = scratch(fps.groupBy("fp").agg(F.min(F.struct("id", "__row")).alias("least")).select("fp", "least"), "representatives", n)
    found = group_fingerprints(reps.select("fp", F.col("fp").alias("rep")), max_bits)
    own = reps.join(found.withColumnRenamed("rep", "fp"), "fp", "left").withColumn("g", F.coalesce("component", "fp"))
    stay = own.groupBy("g").agg(F.min("least").alias("k")).select(F.col("k.id").alias("__id"), F.col("k.__row").alias("__row"))
    copies = scratch(fps.groupBy(F.col("id").alias("__id"), "__row").agg(F.count("*").alias("n")).where("n > 1"), "copies", n // 2)
    if copies.isEmpty():
        return keyed.join(stay, ["__id", "__row"], "left_semi").select("doc.*")
    stay = scratch(stay.join(copies.select("__id", "__row", F.lit(True).alias("many")), ["__id", "__row"], "left"), "stay", n)
    once = keyed.join(stay.where("many is null"), ["__id", "__row"], "left_semi").select("doc")
    # of equal rows each task sends one
    often = keyed.join(stay.where("many"), ["__id", "__row"], "left_semi").groupBy("__id", "__row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return once.unionByName(often).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
