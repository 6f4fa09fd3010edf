"""Exact substring dedup by prefix-free parsing.

Every byte of a string of `length` bytes that also starts earlier in the corpus is removed (earlier: smaller id, or the
same document further left). The work is done on a parse of the corpus, not on its bytes:

1. Parse. A rolling hash runs over each text; of every `length`-byte string the least hash of its `GRAM`-byte windows
   (the leftmost of equals) is its trigger. Triggers depend on content alone, so equal strings are cut at the same
   place. The strings that share one trigger occurrence form a phrase: the bytes from the start of the first to the end
   of the last, so that neighbouring phrases overlap and each string lies wholly in exactly one phrase occurrence.
2. Parse in corpus order. Phrase occurrences are brought together by trigger. An occurrence of a phrase that is equal
   to an earlier one is repeated as a whole: for repetitive text nearly everything ends here, as numbers, without a
   byte of text moved. Triggers that stand in one phrase only are done as well.
3. Dictionary. What is left are first occurrences of different phrases around one trigger, the dictionary's hard part.
   Their bytes are fetched and the suffixes of the dictionary phrases are sorted, trigger by trigger and to a depth of
   `length`: equal strings share their trigger and lie wholly in a phrase, so neither a suffix of another trigger nor
   the order of the parse behind the phrase can decide between them. Equal strings come next to each other in corpus
   order; all but the first are repeated. Triggers with so many phrases that they would fill a task are not sorted as
   one group: their phrases are cut into portions of WIDTHS strings by the distance to the trigger, and dealt by the
   bytes that all strings of a portion share, which are most of a string. Portions that meet no other are done, groups
   that a task can hold are sorted, and larger ones are cut finer. What still fills a task after the finest cut goes on
   as single strings, dealt by hash and reduced to the first of each in Spark. The result is the same. Very frequent
   triggers are found beforehand in a sixteenth of the documents and dealt by phrase from the start; which ones are
   found decides where rows go and nothing else.
4. The repeated spans of a document meet its text once more, are united and cut out.

Phrases are compared by a 64-bit hash of trigger and another of the whole phrase; the strings in step 3 by their bytes,
or by a 128-bit hash of the portion within a task and of the string where they are dealt by it.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, join_counted, release_memory, scratch

LENGTH, GRAM = 100, 40
#: Phrases that a task sorts at a time, and the most around one trigger.
SORTED = 4096
#: One document in so many is looked through for very frequent triggers.
SAMPLED = 16
#: Occurrences that a parsing task remembers to settle repeats on its own; beyond it it forgets and begins anew.
REMEMBERED = 1_000_000
#: Strings that a task remembers where they are dealt by hash; beyond it it forgets and begins anew.
STRINGS = 200_000
#: The same for portions, whose bytes are held as well.
PORTIONS = 50_000
#: Strings in a portion of a phrase around a trigger with too many of them, and in those of a portion that is still met
#: by too many.
WIDTHS = (16, 4)
NAMES = ["h", "h2", "doc", "start", "last"]
#: Bits for the number of strings in a packed place; the first string's start is above them.
COUNT_BITS = 6
#: Positions share a 64-bit key with the rolling hash, so texts are parsed in overlapping pieces of this many bytes.
PIECE = 1 << 23
_MASK = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
#: States of a phrase occurrence beside 0.
LATER, HOT = 1, 2


def rolling(data: bytes, width: int = GRAM) -> np.ndarray:
    """Hash of every window of `width` bytes, by doubling."""
    one = _BYTES[np.frombuffer(data, dtype=np.uint8)]
    total = len(one)
    current, size, factor = one, 1, _BASE
    done, done_size = None, 0
    left = width
    while left:
        if left & 1:
            if done is None:
                done, done_size = current, size
            else:
                n = total - (done_size + size) + 1
                done = done[:n] * np.uint64(factor) + current[done_size : done_size + n]
                done_size += size
        left >>= 1
        if left:
            n = total - 2 * size + 1
            current = current[:n] * np.uint64(factor) + current[size : size + n]
            size, factor = 2 * size, factor * factor & ((1 << 64) - 1)
    return (done ^ (done >> np.uint64(29))) * _SPREAD


def parse(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, trigger hash) of each phrase occurrence of a text, in order."""
    parts = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        if len(piece) < length:
            break
        hashes = rolling(piece, gram)
        key = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
        span, least, width = length - gram + 1, key, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        strings = len(piece) - length + 1
        if width < span:
            least = np.minimum(least[:strings], least[span - width : span - width + strings])
        trigger = (least & _MASK).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        parts.append((first + at, np.diff(np.append(first, strings)), hashes[trigger[first]].view(np.int64)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _phrases(length: int, gram: int, hot: np.ndarray):
    """Phrase occurrences of a partition.

    state is LATER for those known to repeat an occurrence of the same task and HOT for those around a hot trigger. Rows
    that need not meet others around their trigger are dealt by phrase, or, where nothing is left to find out, anyhow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        frequent = set(hot.tolist())
        for batch in batches:
            out_g, out_c, out_doc, out_place, state = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                if len(data) < length:
                    continue
                first, count, g = parse(data, length, gram)
                places = (first << COUNT_BITS | count).tolist()
                classes = [xxhash.xxh64_intdigest(data[a : a + n + length - 1], 1) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                triggers, marks = g.tolist(), [0] * len(places)
                for k, (c, place) in enumerate(zip(classes, places, strict=True)):
                    seen = known.setdefault(c, (doc, place))
                    if seen < (doc, place):
                        marks[k], triggers[k] = LATER, xxhash.xxh64_intdigest(f"{doc}:{place}") >> 1
                    else:
                        if seen > (doc, place):  # the one remembered comes later
                            out_g.append(xxhash.xxh64_intdigest(f"{seen}") >> 1)
                            out_c.append(c)
                            out_doc.append(seen[0])
                            out_place.append(seen[1])
                            state.append(LATER)
                            known[c] = (doc, place)
                        if triggers[k] in frequent:
                            marks[k], triggers[k] = HOT, c >> 1
                out_g += triggers
                out_c += classes
                out_doc += [doc] * len(places)
                out_place += places
                state += marks
                if len(known) > REMEMBERED:
                    known.clear()
            c = np.array(out_c, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out_g, dtype=np.int64)), pa.array(c), pa.array(np.array(out_doc, dtype=np.int64)), pa.array(np.array(out_place, dtype=np.int64)), pa.array(state, pa.int8())], names=["g", "c", "doc", "place", "state"])
        known.clear()
        release_memory()

    return run


def hot_triggers(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, sampled: int = SAMPLED) -> np.ndarray:
    """Triggers that would fill more than a quarter of an even share of the shuffle partitions, judged by one document
    in `sampled`; there are at most four times as many as partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                found, n = np.unique(parse(text.as_buffer().to_pybytes(), length, gram)[2], return_counts=True)
                for g, k in zip(found.tolist(), n.tolist(), strict=True):
                    total[g] = total.get(g, 0) + k
                if len(total) > REMEMBERED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["g", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["g", "n"])

    chosen = keyed.where(F.pmod(F.xxhash64("doc"), F.lit(sampled)) == 0).select("text")
    counts = scratch(chosen.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"), "triggers")
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(32, total // (4 * partitions))).select("g").collect()
    return np.array([r["g"] for r in found], dtype=np.int64)


def _context(length: int):
    """Bytes of the phrases that a text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, m, doc_out, place_out, bytes_out = [], [], [], [], []
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in asked:
                    first, count = x["place"] >> COUNT_BITS, x["place"] & ((1 << COUNT_BITS) - 1)
                    g.append(x["g"])
                    m.append(x["m"])
                    doc_out.append(doc)
                    place_out.append(x["place"])
                    bytes_out.append(data[first : first + count + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(m, pa.int64()), pa.array(doc_out, pa.int64()), pa.array(place_out, pa.int64()), pa.array(bytes_out, pa.binary())], names=["g", "m", "doc", "place", "phrase"])

    return run


SPAN = "doc long, first long, last long"


def _spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, first, last)], names=["doc", "first", "last"])


def _expand(batch: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes, document, start) of every string of the rows' phrases."""
    place = batch["place"].to_numpy()
    first, count = place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1)
    joined = np.frombuffer(b"".join(batch["phrase"].to_pylist()), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum(count + length - 1)[:-1]])
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    strings = np.lib.stride_tricks.sliding_window_view(joined, length)[begins[row] + step]
    return row, strings, batch["doc"].to_numpy()[row], first[row] + step


def _sorted_repeats(length: int):
    """Repeated strings of whole trigger groups, which come one after the other in corpus order: the suffixes of their
    phrases in order, to a depth of `length`."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        g = rows["g"].to_numpy()
        row, strings, doc, start = _expand(rows, length)
        keyed = np.concatenate([g.astype(">i8").view(np.uint8).reshape(-1, 8)[row], strings], axis=1)
        keyed = np.ascontiguousarray(keyed).view(f"V{length + 8}").ravel()
        text = keyed.view(f"S{length + 8}")
        order = np.argsort(text, kind="stable")
        ranked = text[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        hit = np.sort(order[~head])  # rows come in corpus order, and the sort keeps it
        # neighbouring starts of one phrase make one span
        new = np.concatenate([[True], (row[hit[1:]] != row[hit[:-1]]) | (start[hit[1:]] != start[hit[:-1]] + 1)]) if len(hit) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(hit)) - 1 if len(begin) else begin
        return _spans(doc[hit[begin]], start[hit[begin]], start[hit[end]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            last = batch.column(0)[-1].as_py()
            if size >= 8 * SORTED:
                rows = pa.concat_tables(held)
                g = rows["g"].to_numpy()
                cut = int(np.flatnonzero(g != last)[-1]) + 1 if (g != last).any() else 0
                if cut:
                    for part in _whole_groups(rows.slice(0, cut)):
                        yield settle(part)
                held, size = [rows.slice(cut)], len(rows) - cut
        if held and size:
            for part in _whole_groups(pa.concat_tables(held)):
                yield settle(part)
        release_memory()

    return run


def _whole_groups(rows: pa.Table) -> Iterator[pa.Table]:
    """Slices of about SORTED rows that don't divide a group; a group has at most SORTED first occurrences."""
    g = rows["g"].to_numpy()
    ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
    at = 0
    while at < len(g):
        end = int(ends[max(np.searchsorted(ends, at + SORTED, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        yield rows.slice(at, end - at)
        at = end


def _portions(length: int, gram: int, width: int):
    """Phrases cut at distances from the trigger that `width` divides, and g from what a portion's strings share.

    Equal strings lie at one distance from their trigger, so portions that hold them have one g. Of equal portions a
    task sends the first that it has met; later ones go without g and bytes, as repeated wholes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int, bytes]] = {}

        def rows(g, doc, place, data) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary())], names=["g", "doc", "place", "phrase"])

        def firsts() -> pa.RecordBatch:
            doc, place, g, data = zip(*known.values(), strict=True)
            return rows(g, doc, place, data)

        for whole in batches:
            for at in range(0, whole.num_rows, SORTED):
                part = whole.slice(at, SORTED)
                texts, places = part.column("phrase").to_pylist(), part.column("place").to_pylist()
                begins = np.cumsum([0, *map(len, texts[:-1])])
                hashes = rolling(b"".join(texts), gram) & ~_MASK  # as in parse(), the leftmost of the least
                triggers = np.lib.stride_tricks.sliding_window_view(hashes, length - gram + 1)[begins].argmin(axis=1)
                later: list[tuple[int, int]] = []
                for doc, place, data, t in zip(part.column("doc").to_pylist(), places, texts, triggers.tolist(), strict=True):
                    first, count = place >> COUNT_BITS, place & ((1 << COUNT_BITS) - 1)
                    i = 0
                    while i < count:
                        k = (t - i) // width
                        shared = t - k * width  # start of the last string of a whole portion, where the shared bytes begin
                        end = min(count, shared + 1)
                        portion, place = data[i : end - 1 + length], first + i << COUNT_BITS | end - i
                        h = xxhash.xxh3_128_digest(portion)
                        seen = known.get(h)
                        if seen and seen[:2] < (doc, place):
                            later.append((doc, place))
                        elif not seen or seen[:2] > (doc, place):
                            if seen:  # the one remembered comes later
                                later.append(seen[:2])
                            known[h] = (doc, place, xxhash.xxh64_intdigest(data[shared : shared - width + 1 + length], k) >> 1, portion)
                        i = end
                if later:
                    none = [None] * len(later)
                    yield rows(none, *zip(*later, strict=True), none)
                if len(known) > PORTIONS:
                    yield firsts()
                    known.clear()
        if known:
            yield firsts()
        known.clear()
        release_memory()

    return run


def _hashed_strings(length: int):
    """Strings by their hashes: the first of each that a task has met, and runs of later ones as spans without hashes.

    So a string that fills phrases of many documents meets others once a task, not once a phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}

        def firsts() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(known), dtype="<i8").reshape(-1, 2)
            doc, start = (pa.array([x[k] for x in known.values()], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), doc, start, start], names=NAMES)

        for whole in batches:
            for at in range(0, whole.num_rows, SORTED):
                _, strings, doc, start = _expand(pa.Table.from_batches([whole.slice(at, SORTED)]), length)
                data = strings.tobytes()
                later: list[tuple[int, int]] = []
                for k, place in enumerate(zip(doc.tolist(), start.tolist(), strict=True)):
                    h = xxhash.xxh3_128_digest(data[k * length : (k + 1) * length])
                    seen = known.setdefault(h, place)
                    if seen < place:
                        later.append(place)
                    elif seen > place:  # the one remembered comes later
                        later.append(seen)
                        known[h] = place
                if later:
                    x = np.array(sorted(later), dtype=np.int64)
                    new = np.concatenate([[True], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1] + 1)])
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(x)) - 1
                    none = pa.nulls(len(begin), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(x[begin, 0]), pa.array(x[begin, 1]), pa.array(x[end, 1])], names=NAMES)
                if len(known) > STRINGS:
                    yield firsts()
                    known.clear()
        if known:
            yield firsts()
        known.clear()
        release_memory()

    return run


def _release(spark) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referred to: the cleaner acts on garbage collection,
    and a driver with much memory may not collect before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most_sorted: int | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """(doc, first, last): starts of repeated strings. keyed: (doc, text binary), doc all different and in corpus order.

    most_sorted: phrases around one trigger that a task may sort; if None, a quarter of an even share of the shuffle
    partitions, SORTED at most. hot: triggers that are dealt by phrase; if None, hot_triggers() finds them. Neither
    changes the result.
    """
    spark = keyed.sparkSession
    hot = hot_triggers(keyed, length, gram) if hot is None else hot
    found = keyed.select("doc", "text").mapInArrow(_phrases(length, gram, hot), "g long, c long, doc long, place long, state byte")
    # places of one document order as their starts do
    by_trigger, later = Window.partitionBy("g"), F.col("state") == LATER
    found = found.withColumn("n", F.count("*").over(by_trigger)).where(f"state <> 0 or n > 1")
    in_order = Window.partitionBy("g", "c").orderBy("doc", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("first", F.first(F.struct("doc", "place")).over(in_order)).withColumn("later", later | (F.struct("doc", "place") > F.col("first")))
    found = found.withColumn("m", F.sum(F.when(F.col("later"), 0).otherwise(1)).over(by_trigger)).where("later or state <> 0 or m > 1")
    found = found.withColumn("m", F.when(F.col("state") == HOT, F.lit(1 << 62)).otherwise(F.col("m")))
    found = scratch(found.select("g", "doc", "place", "later", "m"), "phrases")
    _release(spark)
    at, count = F.shiftright("place", COUNT_BITS), F.col("place").bitwiseAND((1 << COUNT_BITS) - 1)
    whole = found.where("later").select("doc", at.alias("first"), (at + count - 1).alias("last"))
    asked = found.where("not later").groupBy("doc").agg(F.collect_list(F.struct("g", "m", "place")).alias("asked"))
    phrases = keyed.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_context(length), "g long, m long, doc long, place long, phrase binary")
    phrases = scratch(phrases, "dictionary")
    _release(spark)
    if most_sorted is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most_sorted = min(SORTED, max(64, phrases.count() // (4 * partitions)))
    keep = ["g", "doc", "place", "phrase"]
    few, many = phrases.where(F.col("m") <= most_sorted).select(keep), phrases.where(F.col("m") > most_sorted).select(keep)
    for width in WIDTHS:
        if many.isEmpty():
            break
        dealt = scratch(many.select(keep[1:]).mapInArrow(_portions(length, gram, width), "g long, doc long, place long, phrase binary"), "portions")
        whole = whole.unionByName(dealt.where("g is null").select("doc", at.alias("first"), (at + count - 1).alias("last")))
        dealt = dealt.where("g is not null")
        groups = scratch(dealt.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "portion-groups", dealt.count())
        few = few.unionByName(join_counted(dealt, groups.where(F.col("n") <= most_sorted), ["g"]))
        many = join_counted(dealt, groups.where(F.col("n") > most_sorted), ["g"])
    few = few.repartition("g").sortWithinPartitions("g", "doc", "place").mapInArrow(_sorted_repeats(length), SPAN)
    strings = scratch(many.select(keep[1:]).mapInArrow(_hashed_strings(length), "h long, h2 long, doc long, start long, last long"), "strings")
    known, strings = strings.where("h is null").select("doc", F.col("start").alias("first"), "last"), strings.where("h is not null").select("h", "h2", "doc", "start")
    start = F.struct("doc", "start")
    earliest = strings.groupBy("h", "h2").agg(F.min(start).alias("a"), F.count("*").alias("n")).where("n > 1")
    many = join_counted(strings, scratch(earliest, "first-strings", strings.count()), ["h", "h2"]).where(start > F.col("a")).select("doc", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(few).unionByName(known).unionByName(many)


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sums, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                if found.is_valid:
                    pairs = found.values
                    a, b = pairs.field("first").to_numpy(), pairs.field("last").to_numpy() + length
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    begins, ends = a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                    rest = b"".join(data[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True))
                    spans.append(len(begins))
                else:
                    rest = data
                    spans.append(0)
                removed.append(len(data) - len(rest))
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            sizes = pa.array([len(t.as_buffer()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, id, text binary) of all rows: doc is different for different documents and follows their order; and, if
    ids repeat or are null, the rows of each doc as (doc, n).

    Ids that are all different and not null are the numbers themselves. Otherwise the different pairs of id and text are
    sorted and numbered, null ids last, texts of one id by their hashes.
    """
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if docs.select(id_.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.select(id_.alias("doc"), id_.alias("id"), text.cast("binary").alias("text")), None
    keys = ["rank", "h", "h2"]
    keyed = docs.select(F.coalesce(id_, F.lit(NULL_ID)).alias("rank"), F.xxhash64(text).alias("h"), F.hash(text).alias("h2"), id_.alias("id"), text.cast("binary").alias("text"))
    distinct = keyed.groupBy(*keys).agg(F.count("*").alias("n")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = scratch(distinct.withColumn("doc", F.monotonically_increasing_id()), "numbers")
    return join_counted(keyed, number, keys).select("doc", "id", "text"), number.select("doc", "n")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of docs: (id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, null unless with_text).

    Null texts count as empty. Null ids rank last. Rows alike in id and text are one document with as many result rows;
    rows with equal ids (or both null) and different texts are documents of their own, ordered by a hash of their texts.
    Other columns are not looked at. An empty table gives an empty result.
    """
    if not GRAM < length <= GRAM + (1 << COUNT_BITS) - 2:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + (1 << COUNT_BITS) - 2}")
    keyed, rows = numbered(docs, id_col, text_col)
    gather = lambda spans: spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    if rows is None:
        known = keyed.join(gather(repeated_spans(keyed, length)), "doc", "left")
    else:  # rows alike are parsed once
        found = gather(repeated_spans(keyed.select("doc", "text").dropDuplicates(["doc"]), length))
        known = join_counted(keyed, scratch(found.join(rows, "doc"), "document-spans"), ["doc"], how="left")
    return known.select("id", "text", "spans").mapInArrow(_cut(length, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id").drop("kept")
