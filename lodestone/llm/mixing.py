"""Mixing sources to target weights: hash-random order, prefix sums over key ranges, an exact cut per source.

Documents of a source are ordered by a hash of their id. The key space of each source is cut into ranges of about
`rows_per_range` documents; sums of the ranges give every range its offset, and only the range that holds a source's
cut is summed row by row. The outcome is one row per source (full epochs, the key of the cut, the words taken there),
so documents are then marked without a shuffle of their texts. No task holds more than one range of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, whole_row, words

WEIGHTS, SHARE_HALVES, CAP, SEED = (3, 1, 2), 3, 2, "mix"


def _keys(id_col: str, source_col: str, text_col: str, seed: str) -> dict[str, Column]:
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    return {
        "__nosource": F.col(source_col).isNull(),
        "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "__size": F.size(words(text)).cast("long"),
        "__key": F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc, F.lit("null")))), F.lpad(F.hex(F.xxhash64(text)), 16, "0")),
    }


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(__nosource, __source, __total) with each source's target: 150% of all sizes shared by weight, at most 2 x its size.

    Raising one level until the shares add up is what resharing excesses by weight comes to. Sources fill up in the
    order of cap over weight, so the level is found from running sums over the sources alone.
    """
    place = F.row_number().over(Window.orderBy("__nosource", "__source")) - 1
    given = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), place % len(weights))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__total") / F.col("w"), "__nosource", "__source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    t = sizes.withColumn("w", given).withColumns({
        "all": F.sum("__total").over(everything),
        "full": F.coalesce(F.sum("__total").over(by_ratio), zero),
        "left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio), zero),
    })
    # what is left for this source and those after it, times 2
    t = t.withColumn("rest", SHARE_HALVES * F.col("all") - 2 * CAP * F.col("full"))
    t = t.withColumn("capped", F.col("rest") * F.col("w") >= 2 * CAP * F.col("__total") * F.col("left"))
    first = Window.partitionBy()
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("__total") / F.col("w"), F.col("__nosource"), F.col("__source"), F.col("rest"), F.col("left")))).over(first)
    t = t.withColumn("level", level)
    target = F.when(F.col("capped"), (CAP * F.col("__total")).cast("double")).otherwise((F.col("level.rest") * F.col("w")).cast("double") / (2 * F.col("level.left")).cast("double"))
    return t.select("__nosource", "__source", "__total", "__rows", target.alias("__target"))


def cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, rows_per_range: int = 4096) -> DataFrame:
    """One row per source: its target, full epochs, and where the last epoch is cut. sized: a written table of keys."""
    source = ["__nosource", "__source"]
    per = sized.groupBy(*source).agg(F.sum("__size").alias("__total"), F.count("*").alias("__rows"))
    aim = scratch(targets(per, weights), "targets").withColumn("__budget", F.floor(F.col("__target") + 0.5).cast("long"))
    aim = aim.withColumn("__epochs", F.when(F.col("__total") > 0, F.expr("__budget div __total")).otherwise(0).cast("long"))
    aim = aim.withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__total"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("__rows") / rows_per_range))
    ranged = sized.join(aim.select(*source, ranges.alias("__n")), source)
    ranged = ranged.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.col("__n") / float(1 << 32)).cast("long"))
    sums = ranged.groupBy(*source, "__range").agg(F.sum("__size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*source).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.withColumn("offset", before).join(aim.select(*source, "__rest"), source)
    holds = sums.where("offset < __rest and offset + s >= __rest")
    inside = ranged.join(holds.select(*source, "__range", "offset", "__rest"), [*source, "__range"])
    ties = inside.groupBy(*source, "__key").agg(F.sum("__size").alias("s"), F.count("*").alias("n"), F.first("offset").alias("offset"), F.first("__rest").alias("__rest"))
    run = F.col("offset") + F.coalesce(F.sum("s").over(Window.partitionBy(*source).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    at = ties.withColumn("run", run).where("run < __rest and run + s >= __rest")
    # rows alike in id and text share what is left at the cut
    at = at.select(*source, F.col("__key").alias("__cut"), F.expr("(__rest - run) div n").alias("__part"))
    # written, so that the joins that follow know how small it is
    return scratch(aim.join(at, source, "left").select(*source, "__total", "__target", "__epochs", "__cut", "__part"), "cuts", aim.count())


def _taken() -> Column:
    last = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(F.col("__key") == F.col("__cut"), F.least("__size", "__part")).otherwise(0)
    return F.col("__epochs") * F.col("__size") + F.coalesce(last, F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: (id, source, size, source_size, target, taken). Null and blank texts have size 0 and
    are taken 0 words. A null source is a source of its own, ordered last. Null ids are one id. Rows alike in id and
    text that meet at a cut share its words evenly. If no text has words every target is 0. Empty table: empty result.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *[c.alias(k) for k, c in _keys(id_col, source_col, text_col, seed).items()])
    sized = scratch(sized, "sized")
    marked = sized.join(cuts(sized.drop("id", "source"), weights), ["__nosource", "__source"])
    return marked.select("id", "source", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), _taken().alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' own columns, a row for each epoch in which a document is taken.

    A document at its source's cut comes with the leading words that the budget still holds. Documents that the mix
    does not take are left out; those without words are taken zero words, so they are left out as well. Columns may
    have any names.
    """
    keyed = docs.select(whole_row(docs).alias("doc"), *[c.alias(k) for k, c in _keys(id_col, source_col, text_col, seed).items()])
    sized = scratch(keyed.select("__nosource", "__source", "__size", "__key"), "sized")
    marked = keyed.join(cuts(sized, weights), ["__nosource", "__source"]).withColumn("__taken", _taken()).where("__taken > 0")
    whole = F.expr("__taken div __size")
    part = F.col("__taken") - whole * F.col("__size")
    epochs = F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = marked.withColumn("__words", F.explode(epochs))
    own = F.col("doc").getField(text_col)
    lead = F.array_join(F.slice(F.regexp_extract_all(own.cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") == F.col("__size"), own).otherwise(lead)
    return rows.withColumn("doc", F.col("doc").withField(f"`{text_col}`", text)).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as k from documents),
s as (select source, sum(size)::bigint as total, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, [3, 1, 2][place % 3 + 1]::bigint as w from s),
r as (select *, sum(total) over () as everything,
    coalesce(sum(total) over (order by total / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    (sum(w) over ()) - coalesce(sum(w) over (order by total / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_w from w),
c as (select *, 3 * everything - 4 * before as rest, (3 * everything - 4 * before) * w >= 4 * total * left_w as capped from r),
l as (select *, (min(struct_pack(a := total / w, b := source is null, c := coalesce(source, ''), rest := rest, left_w := left_w)) filter (where not capped) over ()) as level from c),
t as (select source, total, case when capped then (2 * total)::double else (level.rest * w)::double / (2 * level.left_w)::double end as target from l),
b as (select *, floor(target + 0.5)::bigint as budget, case when total > 0 then floor(target + 0.5)::bigint // total else 0 end as epochs from t),
o as (select d.*, coalesce(sum(size) over (partition by source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d)
select o.doc_id, o.size, b.total as source_size, b.target, (b.epochs * o.size + greatest(0, least(o.size, b.budget - b.epochs * b.total - o.before)))::bigint as taken
from o join b on o.source is not distinct from b.source
"""
