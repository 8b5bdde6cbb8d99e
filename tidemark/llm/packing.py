"""Packing by optimal length buckets.

A global histogram of lengths (one job, a bounded number of bins) goes to a dynamic programme that picks the bucket
boundaries with the least padding; inside a bucket, batches are filled up to a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD
from .shared import materialize

#: Buckets, tokens of a padded batch, and the bits of a length that the histogram keeps (bins: at most 2^BITS per octave).
BUCKETS, BUDGET, BITS = 8, 65536, 7
SLICES = 4096


def _bin(bits: int):
    """Lengths up to 2^bits keep their own bin, longer ones their leading bits: under 2^(bits-1) * (64 - bits) bins in all."""
    spare = f"cast(greatest(0, length(bin(__len)) - {bits}) as int)"
    return F.expr(f"shiftleft(shiftright(__len, {spare}), {spare})")


def bucket_bounds(bins: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """bins: (longest length, rows, sum of lengths), ascending. The at most `buckets` upper bounds, each some bin's longest
    length, for which the padding (bound - length, summed over rows) is least; of equal sums the one with fewer buckets."""
    if not bins:
        return []
    top = np.array([b[0] for b in bins], np.float64)
    rows = np.concatenate([[0], np.cumsum([b[1] for b in bins], dtype=np.float64)])
    total = np.concatenate([[0], np.cumsum([b[2] for b in bins], dtype=np.float64)])
    n = len(bins)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    steps = []
    final, used = np.inf, 0
    for k in range(min(buckets, n)):
        now, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + top[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            last[j] = int(np.argmin(cost))
            now[j] = cost[last[j]]
        steps.append(last)
        best = now
        if now[n] < final:
            final, used = now[n], k + 1
    out, j = [], n
    for last in reversed(steps[:used]):
        out.append(int(top[j - 1]))
        j = last[j]
    return out[::-1]


def pack(docs: DataFrame, length=None, buckets: int = BUCKETS, budget: int = BUDGET, bits: int = BITS) -> DataFrame:
    """doc_id, length, bucket (from 0), bucket_len (padded length), batch (number within its bucket), slot (place in it).

    A batch holds budget // bucket_len rows, one at least (a document longer than the budget is a batch of its own). Length is
    the number of words unless a column is given; null counts as 0 and shares the lowest bucket with padding as any row. Rows
    go to batches in the order of the hash of id and text (where there is one), so batches mix sources; repeated rows are separate
    rows. No rows, no result. bits: how exactly the histogram keeps lengths; with the bits of the longest length (up to 63) the
    bounds are the best ones, at a bin for each length."""
    length = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)) if length is None else length, F.lit(0)).cast("long")
    key = F.xxhash64("doc_id", *(["text"] if "text" in docs.columns else []))
    rows = materialize(docs.select("doc_id", length.alias("__len"), key.alias("__key")))
    hist = rows.groupBy(_bin(bits).alias("b")).agg(F.max("__len").alias("top"), F.count("*").alias("n"), F.sum("__len").alias("s"))
    bounds = bucket_bounds(sorted((r.top, r.n, r.s) for r in hist.collect()), buckets)
    bound = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(bound, lambda b: b < F.col("__len")))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(bound, F.col("bucket") + 1)).withColumn("slice", F.pmod(F.col("__key"), F.lit(SLICES)))
    cells = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("bucket", "slice", before.alias("before"))  # at most buckets * SLICES rows
    nth = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("__key", "doc_id", "__len"))
    place = F.col("before") + F.col("nth") - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return placed.withColumn("nth", nth).join(F.broadcast(cells), ["bucket", "slice"]).select("doc_id", F.col("__len").alias("length"), "bucket", "bucket_len", place.alias("place"), per.alias("per")).select(
        "doc_id", "length", F.col("bucket").cast("int").alias("bucket"), "bucket_len", F.floor(F.col("place") / F.col("per")).cast("long").alias("batch"), (F.col("place") % F.col("per")).cast("long").alias("slot"))


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
