"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours is cut into equal parts with few edges between them, and a small classifier
learns to name a vector's part. Every row is then filed under its most probable part; a query goes to its several most probable
ones, as many as the sample shows to be needed, and everything there is ranked by exact inner products.

Equal vectors cannot crowd a part: of each distinct vector only the k + 1 smallest ids can ever be among k neighbours (ties go
to smaller ids, and one may be the query's own), so the others are not compared; this loses nothing. Parts and their queries are
cut into blocks of bounded size, one task for each pair of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Rows fitted on for each part, and at most; parts at most; neighbours in the graph.
PER_PART, SAMPLE, PARTS, DEGREE = 96, 65536, 1024, 10
#: Share of a sample query's true neighbours that its parts must hold (above the 0.9 asked for, since rows outside the sample
#: are harder), hidden units of the classifier.
REACH, HIDDEN = 0.985, 128
#: Rows and queries of one task.
ROWS, QUERIES = 8192, 2048


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, seed: int = 3, sweeps: int = 12) -> np.ndarray:
    """Part of each node of the graph (row i: i's neighbours); no part exceeds its equal share by more than 5 %. Starts from
    median cuts along principal directions, then nodes move to the part of most of their neighbours where there is room."""
    n, rng = len(x), np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, k = todo.pop()
        if k == 1:
            part[nodes] = first
            continue
        own = x[nodes] - x[nodes].mean(0)
        axis = np.linalg.svd(own[rng.permutation(len(own))[:2000]], full_matrices=False)[2][0] if len(own) > 1 else own[0]
        order = nodes[np.argsort(own @ axis, kind="stable")]
        cut = len(order) * (k // 2) // k
        todo += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    both = [np.array(b, np.int64) for b in both]
    room, size = int(np.ceil(1.05 * n / parts)), np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            votes[size >= room] = -1
            best = int(votes.argmax())
            if best != part[i] and votes[best] > np.count_nonzero(part[both[i]] == part[i]):
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """One hidden layer of rectified units and a softmax over parts, on vectors scaled to unit length."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2


def fit(x: np.ndarray, parts: int, k: int, seed: int = 5, epochs: int = 30) -> Router:
    """Graph, partition, classifier and number of probes from the sampled rows x (distinct, finite, not zero)."""
    rng, n = np.random.default_rng(seed), len(x)
    parts = max(1, min(parts, n // 4))
    near = np.zeros((n, min(max(DEGREE, k), max(n - 1, 0))), np.int64)
    for i in range(0, n, 256):
        s = x[i : i + 256] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[i : i + len(s)]
        near[i : i + len(s)] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1), 1) if near.shape[1] else top
    part = balanced_parts(near[:, :DEGREE], x, parts)
    # The label of a node is spread over the parts of its neighbours: that is where a query like it must look.
    soft = np.zeros((n, parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 0.5 / max(near.shape[1], 1))
    soft[np.arange(n), part] += 1 - soft.sum(1)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    w1 = (rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]) * 2).astype(np.float32)
    w2 = (rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN)).astype(np.float32)
    theta = [w1, np.zeros(HIDDEN, np.float32), w2, np.zeros(parts, np.float32)]
    speed, square, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for epoch in range(epochs):
        for b in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(0, u[b] @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - soft[b]) / len(b)
            back = (g @ theta[2].T) * (h > 0)
            t += 1
            for q, (own, grad) in enumerate(zip(theta, (u[b].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True)):
                speed[q] = 0.9 * speed[q] + 0.1 * grad
                square[q] = 0.999 * square[q] + 0.001 * grad * grad
                own -= 3e-3 * (1 - epoch / epochs) * (speed[q] / (1 - 0.9**t)) / (np.sqrt(square[q] / (1 - 0.999**t)) + 1e-8)
    router = Router(*(p.astype(np.float64) for p in theta), probes=parts)
    score = router.scores(x)
    filed, order = score.argmax(1), np.argsort(-score, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None], 1)
    if near.shape[1]:
        needed = np.bincount(place[np.arange(n)[:, None], filed[near[:, :k]]].ravel(), minlength=parts)
        router.probes = int(np.searchsorted(np.cumsum(needed) / needed.sum(), REACH)) + 1
    return router


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products added up in the order of the components, so equal vectors score equally everywhere."""
    total = np.zeros(len(x))
    for d in range(len(q)):
        total += x[:, d] * q[d]
    return total


def _best(k: int):
    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: rows of a block (vec_id, embedding); right: queries of a block (query_id, embedding)."""
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, ids = np.stack(left["embedding"].to_numpy()).astype(np.float64), left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        qs, qids = np.stack(right["embedding"].to_numpy()).astype(np.float64), right["query_id"].to_numpy()
        out = []
        for i in range(0, len(qs), 256):
            s = qs[i : i + 256] @ x.T
            single = len(head) == len(ids)
            for r in range(len(s)):
                q = i + r
                own = np.searchsorted(ids, qids[q])
                while own < len(ids) and ids[own] == qids[q]:
                    s[r, own] = -np.inf
                    own += 1
                near = s[r] if single else np.maximum.reduceat(s[r], head)  # of an id its nearest vector
                if len(near) > k:
                    bar = np.partition(near, len(near) - k)[len(near) - k]
                    c = np.flatnonzero(s[r] >= bar - 1e-9 * (1 + abs(bar)))
                else:
                    c = np.arange(len(ids))
                c = c[s[r, c] > -np.inf]
                e = _exact(qs[q], x[c])
                best = np.lexsort((ids[c], -e))
                if not single:
                    best = best[np.sort(np.unique(ids[c][best], return_index=True)[1])]
                best = best[:k]
                out.append((np.full(len(best), qids[q]), ids[c][best], e[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return search


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, its k nearest found, largest inner product first,
    ties to smaller ids.

    Rows without id, and vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do those
    whose length isn't the commonest. A repeated (vec_id, vector) counts once; an id with several vectors
    is one item, as near to another as the nearest two of their vectors. No valid rows, no result; fewer than k others,
    all of those found. Other columns are ignored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.filter(finite & F.exists("embedding", lambda c: c != 0))
    v = materialize(v.withColumn("h", F.xxhash64("embedding")))
    common = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.filter(F.size("embedding") == common["d"])
    # Of each distinct vector the k + 1 smallest ids, first within slices of ids so that a common vector is not gathered whole.
    ids = v.select("h", "vec_id").distinct().withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("h", "slice").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("h", "vec_id")
    rows = materialize(v.dropDuplicates(["vec_id", "h"]).join(few, ["h", "vec_id"]).select("vec_id", "embedding", "h"))
    n = rows.count()
    parts = int(np.clip(round(np.sqrt(n) / 6), 1, PARTS))
    sample = rows.dropDuplicates(["h"]).orderBy(F.xxhash64("h"), "h").limit(min(SAMPLE, PER_PART * parts)).select("embedding").toArrow()
    router = spark.sparkContext.broadcast(fit(_matrix(sample.column(0).combine_chunks()), parts, k))  # a network of bounded size

    def file(batches):
        for batch in batches:
            top = router.value.scores(_matrix(batch.column(1))).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.int32())], ["vec_id", "embedding", "part"])

    def route(batches):
        m = router.value.probes
        for batch in batches:
            top = np.argsort(-router.value.scores(_matrix(batch.column(1))), axis=1, kind="stable")[:, :m]
            many = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1) * top.shape[1], pa.int32()), pa.array(top.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), many], ["query_id", "embedding", "parts"])

    filed = materialize(rows.select("vec_id", "embedding").mapInArrow(file, "vec_id long, embedding array<double>, part int"))
    asked = v.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h"]).select("vec_id", "embedding").mapInArrow(route, "query_id long, embedding array<double>, parts array<int>")
    asked = materialize(asked.withColumn("part", F.explode("parts")).drop("parts"))
    sizes = filed.groupBy("part").agg(F.ceil(F.count("*") / ROWS).alias("nb")).join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).alias("nq")), "part")  # a row for each part
    spread = lambda d, key, n, m, name, other: d.join(F.broadcast(sizes), "part").withColumn(name, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m).cast("int") - 1))).select("part", "b", "q", key, "embedding")
    left = spread(filed, "vec_id", "nb", "nq", "b", "q")
    right = spread(asked, "query_id", "nq", "nb", "q", "b")
    found = left.groupBy("part", "b", "q").cogroup(right.groupBy("part", "b", "q")).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
