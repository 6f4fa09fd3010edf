"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that hold a word. A run is `window` consecutive lines; a single line of at
least `long_words` words counts as a run too. Every run that also starts earlier in the corpus (smaller id, or the same
document further up) is deleted; overlapping runs join into longer ones, so a repeated passage goes as a whole.

Winnowing keeps the search small: of each run only its least line hash (the leftmost of equals) is a fingerprint, and
any two equal runs share it at the same place. Fingerprints that occur once in the corpus end there. The others are
extended: the lines around them, up to window - 1 to either side, give the runs that they stand for, and equal runs are
joined to the first of them. A frequent line costs one row per occurrence: sums are made before every shuffle, and no
pairs of occurrences are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, join_counted, scratch, table, whole_row, words

WINDOW, LONG_WORDS = 2, 50
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    """Rank of a row's id and a hash that tells rows of one id apart."""
    return {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__row": F.xxhash64(_text(text_col))}


def fingerprints(docs: DataFrame, id_col: str, text_col: str, window: int, long_words: int) -> DataFrame:
    """(__id, __row, single, fp, at, around, off): one row per fingerprint.

    at: the fingerprint's place among the lines with words; around: hashes of the lines up to window - 1 to either
    side; off: the fingerprint's place in there. Long lines are fingerprints of their own (single).
    """
    lines = F.filter(F.split(_text(text_col), "\n"), lambda x: x.rlike(_HAS_WORD))
    long = lambda x: F.when(F.size(words(x)) >= long_words, F.xxhash64(x, F.lit("long")))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), long(x).alias("g")))
    d = docs.select(*[c.alias(k) for k, c in _keys(id_col, text_col).items()], hashed.alias("l"))
    d = d.select("__id", "__row", F.col("l.h").alias("h"), F.col("l.g").alias("g"))
    starts = F.when(F.size("h") >= window, F.sequence(F.lit(0), F.size("h") - window)).otherwise(F.array().cast("array<int>"))
    chosen = F.array_distinct(F.transform(starts, lambda i: i + _least(F.slice(F.col("h"), i + 1, window))))
    begin = lambda p: F.greatest(p - (window - 1), F.lit(0))
    end = lambda p: F.least(p + (window - 1), F.size("h") - 1)
    many = F.transform(chosen, lambda p: F.struct(F.lit(False).alias("single"), F.get("h", p).alias("fp"), p.alias("at"), F.slice(F.col("h"), begin(p) + 1, end(p) - begin(p) + 1).alias("around"), (p - begin(p)).alias("off")))
    lone = F.filter(F.transform("g", lambda g, i: F.struct(F.lit(True).alias("single"), g.alias("fp"), i.alias("at"), F.array(F.get("h", i)).alias("around"), F.lit(0).alias("off"))), lambda x: x["fp"].isNotNull())
    return d.select("__id", "__row", F.inline(F.concat(many, lone)))


def _least(hashes: Column) -> Column:
    """Place of the least hash, the leftmost of equals."""
    return (F.array_position(hashes, F.array_min(hashes)) - 1).cast("int")


def _extended(met: DataFrame, window: int) -> DataFrame:
    """(__id, __row, single, at, run): the runs that a fingerprint stands for, from the lines around it."""
    starts = F.when(F.size("around") >= window, F.sequence(F.lit(0), F.size("around") - window)).otherwise(F.array().cast("array<int>"))
    own = lambda s: (s <= F.col("off")) & (s + _least(F.slice(F.col("around"), s + 1, window)) == F.col("off"))
    many = F.transform(F.filter(starts, own), lambda s: F.struct((F.col("at") - F.col("off") + s).alias("start"), F.slice(F.col("around"), s + 1, window).alias("run")))
    lone = F.array(F.struct(F.col("at").alias("start"), F.array(F.get("around", F.lit(0)), F.col("fp")).alias("run")))
    return met.select("__id", "__row", "single", F.inline(F.when(F.col("single"), lone).otherwise(many))).withColumnRenamed("start", "at")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(__id, __row, gone array<int>): places, among the lines with words, that lie in a repeated run."""
    found = scratch(fingerprints(docs, id_col, text_col, window, long_words), "line-fingerprints")
    n = found.count()
    # join positions: fingerprints that occur at one place only stand for no repeat
    place = F.struct("__id", "__row", "at")
    often = found.groupBy("single", "fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("single", "fp", "n")
    # extend both ways: equal lines around a fingerprint make equal runs; the first of each stays
    met = scratch(_extended(join_counted(found, scratch(often, "line-repeats", n // 2), ["single", "fp"]), window), "line-runs", n)
    start = F.struct("__id", "at")
    first = met.groupBy("single", "run").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    later = join_counted(met, scratch(first, "first-runs", n // 2), ["single", "run"]).where(start > F.col("first"))
    covered = F.explode(F.sequence(F.col("at"), F.col("at") + F.when(F.col("single"), 0).otherwise(window - 1)))
    return later.select("__id", "__row", covered.alias("p")).groupBy("__id", "__row").agg(F.collect_set("p").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS, count_col: str | None = "n_lines_removed") -> DataFrame:
    """docs with repeated runs of lines deleted from text_col, plus count_col (long, lines deleted; None: no such
    column); every row stays.

    A null text stays null. Lines without a word are neither matched nor deleted. Null ids rank last and are one id;
    rows that are alike in id and text are one document and keep or lose the same lines. Columns may have any names;
    one named as count_col is replaced. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, window, long_words)
    keyed = docs.select(whole_row(docs).alias("doc"), *[c.alias(k) for k, c in _keys(id_col, text_col).items()]).join(gone, ["__id", "__row"], "left")
    own = F.col("doc").getField(text_col)
    raw = F.split(F.coalesce(own.cast("string"), F.lit("")), "\n")
    # place of each line among those with words, -1 for the others: a running count
    step = lambda a, x: F.struct((a["n"] + x.rlike(_HAS_WORD).cast("int")).alias("n"), F.concat(a["out"], F.array(F.when(x.rlike(_HAS_WORD), a["n"]).otherwise(-1))).alias("out"))
    places = F.aggregate(raw, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])
    kept = F.filter(F.arrays_zip(raw.alias("x"), places.alias("p")), lambda z: ~F.array_contains("gone", z["p"]))
    text = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(F.transform(kept, lambda z: z["x"]), "\n"))
    doc = F.col("doc").withField(f"`{text_col}`", text)
    if count_col is not None:
        doc = doc.withField(f"`{count_col}`", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return keyed.select(doc.alias("doc")).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def duck_sql(docs: str, window: int = WINDOW, long_words: int = LONG_WORDS) -> str:
    """DuckDB text of the same result over a relation with doc_id and text, by comparing whole runs of lines."""
    run = " || chr(10) || ".join(["line", *[f"lead(line, {k}) over d" for k in range(1, window)]])
    return rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from {docs}),
w as (select *, row_number() over (partition by doc_id order by place) as pos from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
r as (select doc_id, pos, {window} as n, {run} as run from w window d as (partition by doc_id order by pos)
    union all select doc_id, pos, 1, chr(10) || line from w where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {long_words}),
f as (select *, min((doc_id, pos)) over (partition by n, run) as earliest from r where run is not null),
g as (select distinct doc_id, unnest(range(pos, pos + n)) as pos from f where (doc_id, pos) > earliest),
k as (select l.doc_id, l.place, l.line, g.pos is not null as gone from l left join w on l.doc_id = w.doc_id and l.place = w.place left join g on g.doc_id = w.doc_id and g.pos = w.pos),
t as (select doc_id, count(*) filter (where gone) as n, coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '') as text from k group by doc_id)
select doc_id, n::bigint as n_lines_removed, length(text)::bigint as n_chars_kept, sha256(text) as kept_sha256 from t
"""


SQL = duck_sql("documents")
