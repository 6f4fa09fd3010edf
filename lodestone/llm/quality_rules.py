"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

Statistics of a text are one expression without a shuffle. The decision list is learned by sequential covering from
labelled statistics: each rule is a conjunction of thresholds grown by FOIL gain on two thirds of the labelled rows and
pruned on the rest, where what is left must cover bad rows precisely; learning ends with the first rule that does not.
Rules become one ordered conditional expression.
Learning sees at most `max_labelled` labelled rows, chosen by a hash of their id (a bound, documented here), and these
as counts of threshold cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, words

MAX_LABELLED = 8192
WINDOW = 5
#: Quantiles of each class between which thresholds are set, and the least bad rows a rule must cover.
POINTS, MIN_COVERED = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), 3
FEATURES = ("words", "mean_chars", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(flagged: Column) -> Column:
    """Words under windows that start at the given sorted positions."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
    return F.aggregate(flagged, start, step, lambda a: a["n"])


def _repeated(hashes: Column) -> Column:
    """Words that lie in a window found twice or more in the text; hashes: one per word."""
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)

    def positions(sorted_pairs: Column) -> Column:
        same = lambda e, k: (e["h"] == F.get(sorted_pairs, k - 1)["h"]) | (e["h"] == F.get(sorted_pairs, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(sorted_pairs, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_covered(let(pairs, positions)))

    return F.when(F.size(hashes) <= WINDOW, 0).otherwise(let(windows, count))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks), one row per input row.

    A null text counts as empty and has zeros throughout.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("r"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    d = docs.select(*keep, let(words(text), of_words).alias("__w"), gone(r"[#*$%&|<>]+").alias("__s"), gone("[A-Z]+").alias("__u"), gone("[!?]+").alias("__m"), let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).alias("__d"))
    named = {"n_words": "__w.n", "word_chars": "__w.c", "n_symbols": "__s", "n_dup_lines": "__d", "n_repeat_words": "__w.r", "n_upper": "__u", "n_marks": "__m"}
    return d.select(*keep, *[F.col(v).cast("long").alias(k) for k, v in named.items()])


def _features() -> dict[str, Column]:
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = _features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]
#: bins by feature, in the fold that prunes, bad rows, good rows
Cell = tuple[tuple[int, ...], bool, int, int]


def learn_rules(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9) -> list[Rule]:
    """Decision list for the class quality 0; labelled: statistics() with columns doc_id and quality.

    Thresholds lie half-way between neighbouring exact quantiles of the classes, so that reruns agree. Of equal gains the
    first condition counts, of equally good prunings the shortest. No labelled rows of either class: no rules.
    """
    rows = labelled.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prunes"), (F.col("quality") == 0).alias("bad"), *[c.alias(k) for k, c in _features().items()])
    by_class = rows.groupBy("bad").agg(*[F.percentile(f, list(POINTS)).alias(f) for f in FEATURES]).collect()
    if len(by_class) < 2:
        return []
    seen = {f: sorted({float(x) for r in by_class for x in r[f]}) for f in FEATURES}
    grid = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in seen.items()}
    binned = [sum([(F.col(f) > t).cast("int") for t in grid[f]], F.lit(0)).alias(f) for f in FEATURES]
    cells = rows.select("prunes", "bad", *binned).groupBy("prunes", *FEATURES).agg(F.sum(F.col("bad").cast("int")).alias("b"), F.count("*").alias("n")).collect()
    data: list[Cell] = [(tuple(r[f] for f in FEATURES), r["prunes"], r["b"], r["n"] - r["b"]) for r in cells]
    conditions = [Condition(f, above, t) for f in FEATURES for t in grid[f] for above in (False, True)]
    rank = {f: {t: k for k, t in enumerate(grid[f])} for f in FEATURES}

    def holds(c: Condition, cell: Cell) -> bool:
        return (cell[0][FEATURES.index(c.feature)] > rank[c.feature][c.threshold]) == c.above

    def total(cells: list[Cell], prunes: bool) -> tuple[int, int]:
        return sum(c[2] for c in cells if c[1] == prunes), sum(c[3] for c in cells if c[1] == prunes)

    def cover(rule: Rule, cells: list[Cell]) -> list[Cell]:
        return [c for c in cells if all(holds(x, c) for x in rule)]

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, inside = (), data
        while len(rule) < max_conditions:
            p0, n0 = total(inside, False)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for c in conditions:
                p, n = total([x for x in inside if holds(c, x)], False)
                if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = c, g
            if best is None:
                break
            rule, inside = (*rule, best), cover((best,), inside)
        if not rule:
            break

        def worth(r: Rule) -> float:
            p, n = total(cover(r, data), True)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        p, n = total(cover(rule, data), True)
        if not p or p < min_precision * (p + n) or p + total(cover(rule, data), False)[0] < MIN_COVERED:
            break
        rules.append(rule)
        data = [c for c in data if not all(holds(x, c) for x in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule fires: an ordered conditional over statistics() columns."""
    out = None
    for rule in rules:
        fires = rule[0].column()
        for c in rule[1:]:
            fires = fires & c.column()
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Statistics of labelled texts that pass the base rules: one label per id, of at most max_labelled ids (the least hashes)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # bounded by max_labelled; written, or the filter below would move under the join and take the statistics of all texts
    texts = scratch(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled-texts")
    return statistics(texts, "text", ("doc_id", "quality")).where(~base_failed())


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics..., base_failed, kept) for every row of docs.

    kept is false where base_failed, else the learned list's verdict. Null and empty texts have no words and fail.
    Without labels of both kinds there are no rules. Ids are passed through; repeated rows stay; extra columns are not
    looked at; an empty table gives an empty result.
    """
    rules = learn_rules(labelled_statistics(docs, labels))
    return statistics(docs, "text", ("doc_id",)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_upper", "n_marks")
