"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors (Params.sample) a neighbour graph is built and cut into balanced parts: median splits along main
axes, then moves of single vectors to the part that holds most of their neighbours, within a balance limit. A small classifier
(one hidden layer) learns to tell from a vector alone where its neighbours are. It then places every vector of the table in one
part and routes each query to its most probable parts, as many as the sample needs for the recall asked for; the vectors there
are reranked by exact distance in double precision.

The number of parts follows the counted table (Params.part_rows vectors each), up to what the sample can tell apart (sample_rows of
its vectors each). Parts are split into blocks of bounded bytes, on the side of the vectors and of the queries, so a part of any size,
such as one that holds many copies of a vector, spreads over tasks; what the driver sees besides the sample is one count for each part.

Defined results: vectors that are null, zero, or hold nulls or non-finite components take no part, nor do those whose length
differs from the most common one, nor those without an id; equal distances go to the smaller id; a query's own row, one row of the
same id and vector, is not its candidate, while further rows of that id are; each row of a repeated query has its own ranks;
fewer candidates than k give all; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Params:
    k: int = 10
    sample: int = 20_000
    sample_bytes: int = 64 << 20
    graph: int = 10
    part_rows: int = 4000
    sample_rows: int = 60
    recall: float = 0.97
    hidden: int = 64
    epochs: int = 20
    block_bytes: int = 32 << 20


@dataclass
class Router:
    """A network with one hidden layer over standardised vectors, and the number of parts to probe."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), block):
        d = squared(x[i : i + block], x)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 6, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """Labels 0 to parts - 1 of at most slack * n / parts vectors each, few graph edges cut."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), dtype=np.int64)
    todo, next_label = [(np.arange(len(x)), parts, 0)], 0
    while todo:
        own, n, first = todo.pop()
        if n == 1:
            label[own] = next_label
            next_label += 1
            continue
        y = x[own] - x[own].mean(0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(12):  # power iteration towards the main axis
            axis = y.T @ (y @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = np.argsort(y @ axis, kind="stable")
        cut = len(own) * (n // 2) // n
        todo += [(own[order[:cut]], n // 2, first), (own[order[cut:]], n - n // 2, first)]
    limit = int(slack * len(x) / parts) + 1
    size = np.bincount(label, minlength=parts)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[graph[i]], minlength=parts)
            best = int(votes.argmax())
            if best != label[i] and votes[best] > votes[label[i]] and size[best] < limit:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def train_router(x: np.ndarray, p: Params, rows: int | None = None, seed: int = 3) -> Router:
    """Fit on a sample of a table of so many rows: graph, parts, classifier, and the probes that the sample's own neighbours need."""
    n, d = x.shape
    parts = int(np.clip((n if rows is None else rows) // p.part_rows, 1, max(1, n // p.sample_rows)))
    mean, scale = x.mean(0) if n else np.zeros(d), (x.std(0) + 1e-9) if n else np.ones(d)
    rng = np.random.default_rng(seed)
    w1, w2 = rng.normal(size=(d, p.hidden)) * np.sqrt(2 / max(d, 1)), rng.normal(size=(p.hidden, parts)) * np.sqrt(1 / p.hidden)
    r = Router(mean, scale, w1, np.zeros(p.hidden), w2, np.zeros(parts), 1)
    if parts == 1:
        return r
    graph = neighbour_graph(x, min(p.graph, n - 1))
    label = balanced_parts(x, graph, parts)
    # the target of a vector: the parts of itself and of its neighbours
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n), label), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(n), label[graph[:, j]]), 1.0)
    target /= target.sum(1, keepdims=True)
    z = (x - mean) / scale
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (r.w1, r.b1, r.w2, r.b2)]
    t = 0
    for _ in range(p.epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            own = order[i : i + 256]
            h = np.maximum(z[own] @ r.w1 + r.b1, 0)
            s = h @ r.w2 + r.b2
            s = np.exp(s - s.max(1, keepdims=True))
            g = (s / s.sum(1, keepdims=True) - target[own]) / len(own)
            back = (g @ r.w2.T) * (h > 0)
            t += 1
            for w, grad, (m, v) in zip((r.w1, r.b1, r.w2, r.b2), (z[own].T @ back, back.sum(0), h.T @ g, g.sum(0)), state):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w -= 3e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = r.scores(x)
    place = s.argmax(1)
    rank = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1, kind="stable")
    near = rank[np.arange(n)[:, None], place[graph]]  # the probe that finds each true neighbour
    for probes in range(1, parts + 1):
        r.probes = probes
        if (near < probes).mean() >= p.recall:
            break
    r.probes = min(parts, r.probes + 1)
    return r


def good_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors as doubles)."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    lengths = np.where(valid, np.diff(column.offsets.to_numpy()), -1)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    flat = column.values.cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=float)
    start = column.offsets.to_numpy()[:-1][rows]
    x = values[start[:, None] + np.arange(dim)]
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance) of the k + 1 nearest rows of x: a bound from one matrix product, then exact distances; ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, min(256, (8 << 20) // max(1, len(x))))
    most = (x * x).sum(1).max(initial=0)
    for i in range(0, len(q), step):
        part = q[i : i + step]
        d = squared(part, x)
        tol = 1e-9 * (1 + (part * part).sum(1) + most)
        for row, qv in enumerate(part):
            dist = d[row]
            least = np.partition(dist, k)[k] if len(dist) > k + 1 else np.inf
            near = np.flatnonzero(dist <= least + tol[row])
            exact = np.sqrt(((x[near] - qv) ** 2).sum(1))
            best = np.lexsort((ids[near] != q_ids[i + row], ids[near], exact))[: k + 1]
            out.append((np.full(len(best), i + row), near[best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def fit(vectors: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[Router, int]:
    """(router, dimension) from the vectors with the least hashed ids, bounded in rows and bytes."""
    dims = vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).groupBy(F.size(embedding).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return Router(np.zeros(0), np.ones(0), np.zeros((0, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1), 0
    dim = dims[0]["d"]
    most = int(min(params.sample, params.sample_bytes // (8 * max(1, dim))))
    # equal vectors say nothing new to the graph: one id of each hash is enough; only hashes and ids move
    own = vectors.where((F.size(embedding) == dim) & F.col(vec_id).isNotNull()).select(vec_id, embedding).withColumn("_h", F.xxhash64(embedding))
    chosen = own.groupBy("_h").agg(F.min(vec_id).alias(vec_id)).orderBy(F.xxhash64("_h"), "_h").limit(most)
    got = own.join(F.broadcast(chosen), ["_h", vec_id]).dropDuplicates(["_h"]).orderBy("_h").select(embedding).toArrow()
    _, x = good_vectors(got.column(0), dim)
    return train_router(x, params, dims[0]["n"]), dim


def search(vectors: DataFrame, queries: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", fitted: tuple[Router, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest vectors found for each row of queries."""
    p = params
    spark = vectors.sparkSession
    router, dim = fitted or fit(vectors, p, vec_id, embedding)
    shared = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = good_vectors(b.column(1), dim)
            part = shared.value.scores(x).argmax(1) if len(rows) else np.zeros(0, np.int64)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take).cast(pa.list_(pa.float64())), pa.array(part, pa.int32())], names=["id", "x", "part"])

    index = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long"), embedding).mapInArrow(place, "id long, x array<double>, part int")
    index = stage(index, "index")
    counts = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = good_vectors(b.column(2), dim)
            src, part = [], []
            if len(rows):
                order = np.argsort(-shared.value.scores(x), axis=1, kind="stable")
                for i, parts in zip(rows.tolist(), order.tolist()):
                    have = 0
                    for j, q in enumerate(parts):
                        if j >= shared.value.probes and have > 3 * p.k:
                            break
                        have += counts.get(q, 0)
                        if q in counts:
                            src.append(i)
                            part.append(q)
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take).cast(pa.list_(pa.float64())), pa.array(part, pa.int32())], names=["q", "id", "x", "part"])

    asking = queries.where(F.col(vec_id).isNotNull()).select(F.monotonically_increasing_id().alias("q"), F.col(vec_id).cast("long").alias("id"), embedding)
    routed = stage(asking.mapInArrow(route, "q long, id long, x array<double>, part int"), "routed")
    asked = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    in_block = max(1, p.block_bytes // (8 * max(1, dim)))
    blocks = [(q, -(-counts[q] // in_block), -(-asked[q] // in_block)) for q in asked if q in counts]
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    grid = F.broadcast(spark.createDataFrame(blocks, "part int, nr int, nq int"))  # one row a part
    left = index.join(grid, "part").withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nr")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("part", "rb", "qb", "id", "x")
    right = routed.join(grid, "part").withColumn("qb", F.pmod(F.xxhash64("q", F.lit(2)), F.col("nq")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).select("part", "rb", "qb", "q", "id", "x")

    def rerank(rows: pa.Table, asked_here: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        q, v, d, query_id, own = none, none, np.zeros(0), none, np.zeros(0, bool)
        if rows.num_rows and asked_here.num_rows:
            mat = lambda t: t.column("x").combine_chunks().values.to_numpy(zero_copy_only=False)[: t.num_rows * dim].reshape(t.num_rows, dim)
            ids, q_ids = rows.column("id").to_numpy(), asked_here.column("id").to_numpy()
            a, i, d = nearest(ids, mat(rows), q_ids, mat(asked_here), p.k)
            q, query_id, v = asked_here.column("q").to_numpy()[a], q_ids[a], ids[i]
            own = (query_id == v) & (d == 0)
        return pa.table({"q": q, "query_id": query_id, "vec_id": v, "score": d, "own": own})

    found = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(rerank, "q long, query_id long, vec_id long, score double, own boolean")
    # one row of the query's id and vector is the query itself; of the own rows at distance 0 the first goes
    alike = Window.partitionBy("q").orderBy(F.col("own").desc(), "score", "vec_id")
    found = found.withColumn("_first", F.row_number().over(alike)).where(~(F.col("own") & (F.col("_first") == 1)))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
