"""Embedding near-dedup: an HNSW graph per shard, every shard queried, exact products where recall audits fail.

Equal vectors of a label are one node with a count. The nodes of a label are dealt by hash into shards of about
`shard_size`; each shard's graph is built in one task and written to the shared folder. A shard then meets each other
shard of its label once, in a task that holds its graph and takes the vectors of half of the others one shard after the
other. A query whose beam is full of links is asked again with a wider beam, and if that is full too with one as wide
as the shard, which is a block of products over all its vectors. Queries drawn at random and those with the nearest
neighbours are audited against an exact search of the shard. Where the audit finds a link missing, all beams widen as
long as that costs less than the block products would, and then the products check all queries: each pair of shards is
searched a bounded number of times, whatever its graph misses.
Cosines are verified in double precision. Links are added to sums by node and to a spanning forest as they are found; a
task never holds more of them than a beam for each vector, so a dense group costs memory for its size and not its square.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, scratch
from .components import connected_components, spanning
from .hnsw import M0, Graph

COSINE, SHARD_SIZE, EF = 0.98, 8192, 32
#: Queries audited: one in AUDIT_SHARE at random and as many of those with the nearest neighbours, AUDIT each at least.
AUDIT, AUDIT_SHARE = 64, 64
#: A vector looked at in a graph costs as much as so many in block products: on one core 330 and 50 ns, 64 components.
LOOK = 6
#: float32 dot products may fall short of the double ones by this much.
SLACK = 1e-4
#: Queries answered together.
QUERIES = 256


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: a label, no null or non-finite component, a length that is neither zero nor infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.coalesce(label.isNotNull() & ~bad & (norm > 0) & (norm < float("inf")), F.lit(False))


class Shard:
    """Vectors to be searched, in double precision, with their graph."""

    def __init__(self, vectors: np.ndarray, graph: Graph):
        self.vectors, self.graph, self.norms = vectors, graph, np.linalg.norm(vectors, axis=1)

    def verified(self, queries: np.ndarray, norms: np.ndarray, q: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
        """Which pairs of places have at least this cosine."""
        out = np.zeros(len(q), dtype=bool)
        for at in range(0, len(q), 20_000):
            a, b = q[at : at + 20_000], v[at : at + 20_000]
            out[at : at + 20_000] = np.einsum("kd,kd->k", queries[a], self.vectors[b]) / (norms[a] * self.norms[b]) >= cosine
        return out

    def exact(self, queries: np.ndarray, norms: np.ndarray, cosine: float) -> np.ndarray:
        """Links of a block of queries to all vectors, as a matrix; products that differ from the bound by rounding only
        are taken again pair by pair, so that every way of searching decides alike."""
        products, bound = queries @ self.vectors.T, cosine * norms[:, None] * self.norms[None, :]
        hit = products >= bound
        q, v = np.nonzero(np.abs(products - bound) <= 1e-12 * np.abs(bound))
        hit[q, v] = self.verified(queries, norms, q, v, cosine)
        return hit


class Links:
    """Links of a task: the weight of each node's partners, and the nodes' groups. Queries come after the vectors,
    unless they are the vectors themselves."""

    def __init__(self, copies: np.ndarray, asking: np.ndarray | None = None):
        self.same, self.offset = asking is None, 0 if asking is None else len(copies)
        self.copies = copies if asking is None else np.concatenate([copies, asking])
        self.clear()

    def clear(self) -> None:
        self.sums = np.zeros(len(self.copies), dtype=np.int64)
        self.label = np.arange(len(self.copies))

    def add_rows(self, queries: np.ndarray, hit: np.ndarray, alone: np.ndarray | None = None) -> None:
        """Complete rows of links. alone: for queries among the vectors, those whose own rows do not come: links to them
        count on both sides here."""
        q = queries + self.offset
        if self.same:
            hit[np.arange(len(q)), queries] = False
        self.sums[q] += hit @ self.copies[: hit.shape[1]]
        back = hit.T @ self.copies[q]
        self.sums[: hit.shape[1]] += back if alone is None else np.where(alone, back, 0)
        for k, row in zip(q.tolist(), hit, strict=True):
            found = self.label[np.flatnonzero(row)]
            if len(found) and (found != self.label[k]).any():
                groups = np.unique(np.append(found, self.label[k]))
                self.label[np.isin(self.label, groups)] = groups[0]

    def add_pairs(self, q: np.ndarray, v: np.ndarray) -> None:
        """Links as pairs, each once."""
        np.add.at(self.sums, q + self.offset, self.copies[v])
        np.add.at(self.sums, v, self.copies[q + self.offset])
        parent: dict[int, int] = {}
        spanning(self.label[q + self.offset].tolist(), self.label[v].tolist(), parent)
        top = np.arange(len(self.label))
        for x in sorted(parent):
            top[x] = top[parent[x]]
        self.label = top[self.label]


def collect_links(queries: np.ndarray, shard: Shard, links: Links, cosine: float, ef: int = EF, audit: int = AUDIT) -> int:
    """Add all links of the queries to a shard to `links`, after the audits; the beam's width that passed them, which is
    the shard's size if none did and the links come from block products."""
    norms = np.linalg.norm(queries, axis=1)
    unit = (queries / norms[:, None]).astype(np.float32)
    n, own = len(shard.vectors), 2 if links.same else 1  # of queries among the vectors the nearest is the query itself
    audit = min(len(queries), max(audit, len(queries) // AUDIT_SHARE))
    drawn = np.random.default_rng(len(queries)).permutation(len(queries))[:audit]

    def ask(which: np.ndarray, width: int, nearest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries whose beam is full of links, query and vector of the others' links)."""
        full, qs, vs = [], [], []
        size = max(16, QUERIES * EF // width)
        for at in range(0, len(which), size):
            part = which[at : at + size]
            ids, sims = shard.graph.search(unit[part], width)
            hit = (sims >= cosine - SLACK) & (ids >= 0)
            ordered = np.sort(sims, axis=1)
            nearest[part] = ordered[:, -own] if ordered.shape[1] >= own else -np.inf
            over = hit.all(axis=1)
            full.append(part[over])
            r, c = np.nonzero(hit & ~over[:, None])
            q, v = part[r], ids[r, c]
            ok = shard.verified(queries, norms, q, v, cosine)
            qs.append(q[ok])
            vs.append(v[ok])
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (full, qs, vs))

    def dense_rows(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(which), QUERIES // 2):
            part = which[at : at + QUERIES // 2]
            yield part, shard.exact(queries[part], norms[part], cosine)

    while True:
        links.clear()
        nearest = np.full(len(queries), -np.inf)
        full, q, v = np.arange(len(queries)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for width in (ef, 4 * ef):
            if width < n and len(full):
                full, more_q, more_v = ask(full, width, nearest)
                q, v = np.concatenate([q, more_q]), np.concatenate([v, more_v])
        sparse = np.ones(len(queries), dtype=bool)
        sparse[full] = False
        sample = np.unique(np.concatenate([drawn, np.argsort(-nearest, kind="stable")[:audit]]))
        sample = sample[sparse[sample]]
        counts = np.bincount(q, minlength=len(queries))
        if ef >= n or all((hit.sum(axis=1) == counts[part]).all() for part, hit in dense_rows(sample)):
            break
        ef = min(n, 4 * ef)
        if LOOK * M0 * ef >= n:
            ef, full, q, v = n, np.arange(len(queries)), q[:0], v[:0]
            sparse[:] = False
            break
    for part, hit in dense_rows(full):
        links.add_rows(part, hit, sparse if links.same else None)
    if links.same:  # links between two of the others, found from either side, count once
        both = (q != v) & sparse[v]
        pairs = np.unique(np.minimum(q, v)[both] * n + np.maximum(q, v)[both])
        q, v = pairs // n, pairs % n
    links.add_pairs(q, v)
    return ef


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    vectors = np.array(pdf["vector"].tolist(), dtype=np.float64)
    unit = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    data = pickle.dumps((pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), vectors))
    graph = Graph(unit, seed=int(key[2]))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "data": [data], "graph": [pickle.dumps((graph.level, graph.links))]})


def _load(data: bytes, graph: bytes) -> tuple[np.ndarray, np.ndarray, Shard]:
    nodes, copies, vectors = pickle.loads(data)
    made = Graph.__new__(Graph)
    made.level, made.links = pickle.loads(graph)
    made.unit = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    made.inside = np.ones(len(vectors), dtype=bool)
    return nodes, copies, Shard(vectors, made)


def _search(cosine: float):
    """Rows come by shard: its own with the graph first, then those of the shards that ask it."""

    def answer(nodes: np.ndarray, links: Links) -> pa.RecordBatch:
        counted, moved = np.flatnonzero(links.sums), np.flatnonzero(links.label != np.arange(len(links.label)))
        u = np.concatenate([nodes[counted], nodes[moved]])
        v = pa.array(np.concatenate([np.zeros(len(counted), dtype=np.int64), nodes[links.label[moved]]]), mask=np.arange(len(u)) < len(counted))
        n = np.concatenate([links.sums[counted], np.zeros(len(moved), dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(n)], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = copies = shard = None
        for batch in batches:
            for graph, data in zip(batch.column(0), batch.column(1), strict=True):
                if graph.is_valid:
                    nodes, copies, shard = _load(data.as_py(), graph.as_py())
                    links = Links(copies)
                    collect_links(shard.vectors, shard, links, cosine)
                    yield answer(nodes, links)
                else:
                    asking, weight, queries = pickle.loads(data.as_py())
                    links = Links(copies, weight)
                    collect_links(queries, shard, links, cosine)
                    yield answer(np.concatenate([nodes, asking]), links)
        release_memory()

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Groups of near-duplicate vectors of equal label.

    Returns one row per input row: (id, n_links, component_id, kept): n_links counts the other rows with cosine at or
    above the threshold, component_id is the smallest id reachable. Vectors that cannot link (see usable) stand alone,
    and vectors of different lengths never link. Rows with a null id count as rows; they take their group's smallest
    id (null if it has none) and are not kept. Repeated rows link with each other. Empty table: empty result.
    """
    id_, vec, label = F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), F.col(label_col)
    rows = vectors.select(id_.alias("id"), F.when(usable(vec, label), F.struct(label.alias("label"), vec.alias("vector"))).alias("k"))
    nodes = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = scratch(nodes.select("k.label", "k.vector", "copies", "least", F.monotonically_increasing_id().alias("node")), "nodes")
    nodes = nodes.withColumn("dim", F.size("vector"))
    per = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = nodes.join(per, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    kind = dict(dealt.dtypes)["label"]
    graphs = dealt.select("label", "dim", "shard", "node", "copies", "vector").groupBy("label", "dim", "shard").applyInPandas(_build, f"label {kind}, dim int, shard int, data binary, graph binary")
    graphs = scratch(graphs, "graphs").join(per, ["label", "dim"])
    # of two shards one asks the other; each is asked by the half of the others that come after it, round a circle
    ahead = F.expr("sequence(1, greatest(1, shards div 2))")
    asks = graphs.where("shards > 1").select("label", "dim", F.col("shard").alias("a"), "shards", "data", F.explode(ahead).alias("step"))
    asks = asks.where("2 * step < shards or a < step").withColumn("b", F.expr("(a + step) % shards"))
    asks = asks.select("label", "dim", "b", F.col("a"), F.lit(None).cast("binary").alias("graph"), "data")
    told = graphs.select("label", "dim", F.col("shard").alias("b"), F.lit(-1).alias("a"), "graph", "data")
    keys = ["label", "dim", "b"]
    met = told.unionByName(asks).repartition(max(1, 4 * graphs.count()), *keys).sortWithinPartitions(*keys, "a")
    found = scratch(met.select("graph", "data").mapInArrow(_search(cosine), "u long, v long, n long"), "links")
    degree = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    moved = connected_components(found.where("v is not null").select("u", "v"))
    known = nodes.select("label", "vector", "copies", "least", "node").join(degree, "node", "left").join(moved, "node", "left")
    known = known.withColumn("g", F.coalesce("component", "node"))
    least = known.groupBy("g").agg(F.min("least").alias("component_id"))
    known = known.join(least, "g").select(F.struct("label", "vector").alias("k"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "component_id")
    out = rows.join(known, "k", "left")
    component = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
