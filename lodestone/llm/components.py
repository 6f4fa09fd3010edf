"""Connected components of a link table, in a logarithmic number of joins.

Each partition first reduces its links to a spanning forest (union-find over that partition only), then large-star and
small-star steps alternate until the links no longer change. A node's label is the smallest id that it can reach.
Nothing but two counters per round reaches the driver; every round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

EDGES = "u long, v long"


def spanning(u: list[int], v: list[int], parent: dict[int, int]) -> None:
    """Unite the ends of each link in parent, smaller nodes above larger ones."""

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for x, y in zip(u, v, strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of one partition reduced to one link per node and local root, u > v."""
    parent: dict[int, int] = {}
    for b in batches:
        spanning(b.column(0).to_pylist(), b.column(1).to_pylist(), parent)
    for x in sorted(parent):  # a parent is smaller and thus settled before
        parent[x] = parent[parent[x]]
    nodes = [x for x, top in parent.items() if top != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[x] for x in part], pa.int64())], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every linked node with the smallest id reachable.

    links: (u long, v long), any direction, repeats and self-links allowed; nulls are ignored.
    Returns (node long, component long) for nodes that are not their component's smallest id; an empty link table gives
    an empty result.
    """
    links = links.where("u is not null and v is not null and u <> v")
    edges = scratch(links.select("u", "v").mapInArrow(forest, EDGES), "forest")
    before, n = None, edges.count()
    for _ in range(max_rounds):
        edges = scratch(_small_star(_large_star(edges)), "stars", n)  # a round never adds links
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
