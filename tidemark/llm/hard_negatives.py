"""Hard negatives by bit-sliced integer products.

Vectors of whole numbers lie in blocks, each block as the bit-planes of its components (less the block's least one, so that planes
are not negative). An inner product is built from the most significant plane down. After each plane every pair has an interval:
what the planes still to come can add is at most their weight times the sum of the anchor's positive components, and at least that
times the sum of its negative ones. A pair is dropped as soon as its interval cannot reach a place among the first k; pairs that are
left after all planes have exact scores.

Two searches: each anchor's nearest rows of its own label (the positives), then, for each positive, the nearest rows of other labels
whose score lies in the window that the positive's score opens. Anchors and blocks meet in groups of bounded size, one task for each
pair of groups; a task returns at most k rows for an anchor (and positive), whatever it reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Rows of a block; blocks and anchors that meet in one task at most; groups of blocks at least, where there are so many blocks.
BLOCK, BLOCKS, ANCHORS, SPREAD = 2048, 64, 4096, 64
#: Anchors whose intervals are held at a time; share of live pairs below which pairs are followed one by one.
SLICE, SPARSE = 256, 1 / 24
FIELDS = "block long, n long, low long, width int, ids binary, labels binary, bits binary"


def pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    """A block: ids, labels and the bit-planes of whole numbers x (a row for each vector), the most significant first."""
    low = int(x.min(initial=0))
    u = (x - low).astype(np.uint64)
    width = int(u.max(initial=0)).bit_length()
    planes = [np.packbits((u >> np.uint64(k)).astype(np.uint8) & 1) for k in range(width - 1, -1, -1)]
    return {"n": len(ids), "low": low, "width": width, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "bits": b"".join(p.tobytes() for p in planes)}


def planes(row, size: int) -> np.ndarray:
    """The bits of a block as (plane, vector, component)."""
    raw = np.frombuffer(row["bits"], np.uint8).reshape(row["width"], -1) if row["width"] else np.zeros((0, 0), np.uint8)
    return np.unpackbits(raw, axis=1, count=row["n"] * size).reshape(row["width"], row["n"], size) if row["width"] else np.zeros((0, row["n"], size), np.uint8)


def kth(values: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest of the values among which are marked; where there are fewer, the least possible."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(np.where(among, -values, np.inf), k - 1, axis=1)[:, k - 1]


class Search:
    """The first k rows of each anchor (and window) over blocks of rows, by score, then id. Floats hold whole numbers here, all of
    them below 2^53.

    own: whether rows of the anchor's label count, or those of others. windows: (anchor, window) arrays of the least and the
    greatest score; an anchor's missing windows are empty (least above greatest)."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, places: np.ndarray, windows: tuple[np.ndarray, np.ndarray], k: int, own: bool):
        self.x, self.labels, self.places, self.k, self.own = x, labels, places, k, own
        self.least, self.greatest = windows
        self.bar = self.least.astype(np.float64).copy()
        self.found: list[tuple[np.ndarray, ...]] = []

    def read(self, block: int, ids: np.ndarray, labels: np.ndarray, bits: np.ndarray, low: int) -> None:
        for i in range(0, len(self.x), SLICE):
            self._slice(slice(i, i + SLICE), block, ids, labels, bits, low)

    def _needed(self, some: slice, lower: np.ndarray, upper: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
        """Which live pairs can still be among the first k of a window; raises the bars."""
        need = np.zeros(live.shape, bool)
        for w in range(self.least.shape[1]):
            top = self.greatest[some, w, None]
            if lower.shape[1] >= k:
                sure = live & (lower >= self.least[some, w, None]) & (upper <= top)
                self.bar[some, w] = np.maximum(self.bar[some, w], kth(lower, sure, k))
            need |= (upper >= self.bar[some, w, None]) & (lower <= top)
        return need & live

    def _slice(self, some: slice, block: int, ids: np.ndarray, labels: np.ndarray, bits: np.ndarray, low: int) -> None:
        x = self.x[some]
        plus, minus = np.maximum(x, 0).sum(1, keepdims=True).astype(np.float64), np.minimum(x, 0).sum(1, keepdims=True).astype(np.float64)
        live = (self.labels[some, None] == labels[None]) == self.own
        here = np.flatnonzero(self.places[some, 0] == block)
        live[here, self.places[some, 1][here]] = False
        kind = np.float32 if int(np.abs(x).sum(1).max(initial=0)) < 1 << 24 else np.float64
        left, cols = x.astype(kind), np.arange(len(ids))
        score = np.repeat((x.sum(1, keepdims=True) * low).astype(np.float64), len(ids), axis=1)
        width, plane = len(bits), 0
        while plane < width:
            weight = 1 << (width - 1 - plane)
            score += (left @ bits[plane, cols].astype(kind).T).astype(np.float64) * weight
            plane += 1
            live = self._needed(some, score + (weight - 1) * minus, score + (weight - 1) * plus, live, self.k)
            keep = live.any(0)
            if 2 * keep.sum() < len(cols):
                score, live, cols = score[:, keep], live[:, keep], cols[keep]
            if live.sum() < SPARSE * live.size:
                break
        a, c = np.nonzero(live)
        score, c = score[a, c], cols[c]
        while plane < width and len(a):
            weight = 1 << (width - 1 - plane)
            step = np.concatenate([np.einsum("pd,pd->p", left[a[j : j + 65536]].astype(np.float64), bits[plane, c[j : j + 65536]]) for j in range(0, len(a), 65536)])
            score += step * weight
            plane += 1
            lower, upper = score + (weight - 1) * minus[a, 0], score + (weight - 1) * plus[a, 0]
            need = np.zeros(len(a), bool)
            for w in range(self.least.shape[1]):
                need |= (upper >= self.bar[some, w][a]) & (lower <= self.greatest[some, w][a])
            a, c, score = a[need], c[need], score[need]
        for w in range(self.least.shape[1]):
            ok = (score >= self.bar[some, w][a]) & (score <= self.greatest[some, w][a])
            self.found.append((a[ok] + some.start, np.full(ok.sum(), w), ids[c[ok]], score[ok]))

    def settle(self) -> tuple[np.ndarray, ...]:
        """Anchor, window, id and score of what is among the first k so far; raises the bars to them."""
        a, w, ids, score = (np.concatenate(z) for z in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 4
        by = np.lexsort((ids, -score, w, a))
        a, w, ids, score = a[by], w[by], ids[by], score[by]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(w) != 0)
        head = np.flatnonzero(new)
        rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
        full = rank == self.k - 1
        self.bar[a[full], w[full]] = np.maximum(self.bar[a[full], w[full]], score[full])
        keep = rank < self.k
        self.found = [(a[keep], w[keep], ids[keep], score[keep])]
        return self.found[0]


def _meet(k: int, own: bool, size: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: blocks; right: anchors with their windows (least, greatest)."""
        names = ["block", "place", "window", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        right = right.sort_values(["block", "place"]).reset_index(drop=True)
        most = max(map(len, right["least"]))
        wide = lambda col, fill: np.stack([np.append(np.array(v, np.float64), np.full(most - len(v), fill)) for v in col])
        places = right[["block", "place"]].to_numpy()
        s = Search(np.stack([np.frombuffer(v, "<i8") for v in right["vector"]]), right["label"].to_numpy(), places, (wide(right["least"], np.inf), wide(right["greatest"], -np.inf)), k, own)
        for row in left.sort_values("block").to_dict("records"):
            s.read(row["block"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), planes(row, size), row["low"])
            s.settle()
        a, w, ids, score = s.settle()
        return pd.DataFrame(dict(zip(names, (places[a, 0], places[a, 1], w, ids, score.astype(np.int64)), strict=True)))

    return search


def _pack(batches):
    first, k, held = TaskContext.get().partitionId() << 32, 0, []

    def out(rows):
        ids, labels, x = (np.concatenate([r[c] for r in rows]) for c in range(3))
        b = pack(ids, labels, x)
        return pa.RecordBatch.from_pylist([{"block": first + k, **b}], schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("bits", pa.binary())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        at = 0
        while at < len(ids):
            room = BLOCK - sum(len(r[0]) for r in held)
            held.append((ids[at : at + room], labels[at : at + room], x[at : at + room]))
            at += room
            if sum(len(r[0]) for r in held) == BLOCK:
                yield out(held)
                held, k = [], k + 1
    if held:
        yield out(held)


def _anchors(every: int, size: int):
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                at = np.flatnonzero(ids % every == 0)
                x = np.zeros((len(at), size), np.int64)
                for plane in planes(row, size):
                    x = 2 * x + plane[at]
                x += row["low"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"])), pa.array(at, pa.int64()), pa.array(ids[at]), pa.array(labels[at]), pa.array([v.astype("<i8").tobytes() for v in x], pa.binary())], ["block", "place", "vec_id", "label", "vector"])

    return read


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, embedding).

    Components become floor(scale * x); scores are inner products of these. Anchors: rows whose vec_id `every` divides. An anchor's
    positives: its first `positives` other rows of the same label. For each, the first `negatives` rows of other labels whose
    score is at most the positive's and at least floor[0] / floor[1] of it. Higher scores first, ties by smaller vec_id.

    Rows without id or label, null vectors, those with null or non-finite components or of another length than the commonest (ties:
    the shorter) take no part. Each row stands for itself: equal rows and repeated ids are several candidates, and several
    anchors. Anchors without positives, positives without negatives and empty tables give no rows. Labels are whole numbers. Other
    columns are ignored. Scores must stay below 2^53; vectors for which they may not are refused with an error."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    v = v.filter(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    kinds = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if kinds is None or not kinds["d"]:
        return spark.createDataFrame([], schema)
    size, most = kinds["d"], kinds["most"] * scale + 1
    if size * most * most >= 2.0**52:
        raise ValueError("scores of these vectors do not fit 53 bits: take a smaller scale")
    whole = v.filter(F.size("embedding") == size).select("vec_id", "label", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))
    blocks = materialize(whole.mapInArrow(_pack, FIELDS))
    anchors = materialize(blocks.mapInArrow(_anchors(every, size), "block long, place long, vec_id long, label long, vector binary"))
    n_blocks, n_anchors = blocks.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    nb, na = max(-(-n_blocks // BLOCKS), min(n_blocks, SPREAD)), -(-n_anchors // ANCHORS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("gb", F.pmod(F.xxhash64("block"), F.lit(nb)).cast("int")).withColumn("ga", each(na))

    def met(asked: DataFrame, k: int, own: bool) -> DataFrame:
        right = asked.withColumn("ga", F.pmod(F.xxhash64("block", "place"), F.lit(na)).cast("int")).withColumn("gb", each(nb))
        best = left.groupBy("ga", "gb").cogroup(right.groupBy("ga", "gb")).applyInPandas(_meet(k, own, size), "block long, place long, window long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "id"))
        return materialize(best.withColumn("rank", rank).filter(F.col("rank") <= k))

    open_ = anchors.select("block", "place", "label", "vector", F.array(F.lit(float("-inf"))).alias("least"), F.array(F.lit(float("inf"))).alias("greatest"))
    near = met(open_, positives, True).groupBy("block", "place").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))  # at most `positives` each
    # The least whole number that is not below the share; below 0 the window is empty anyway.
    least = F.expr(f"transform(near, p -> double((p.score * {floor[0]} + if(p.score > 0, {floor[1] - 1}, 0)) div {floor[1]}))")
    asked = materialize(anchors.join(near, ["block", "place"]).withColumn("least", least).withColumn("greatest", F.transform("near", lambda p: p["score"].cast("double"))))
    got = met(asked.select("block", "place", "label", "vector", "least", "greatest"), negatives, False)
    of = F.col("near")[F.col("window").cast("int")]
    return got.join(asked.select("block", "place", "vec_id", "near"), ["block", "place"]).select(
        F.col("vec_id").alias("anchor_id"), of["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )


def op12(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.x, v.x)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
