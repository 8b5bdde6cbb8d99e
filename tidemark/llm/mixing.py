"""Mixing sources to target weights by systematic sampling.

Within each source the documents are laid end to end, each as long as its expected copies; one random offset per source
shifts a ruler with marks at the integers, and a document is emitted once for every mark inside it. Documents are laid in
order of size, so the words taken differ from the target by about one document.

The prefix sums never gather a source in one task: rows are first counted per cell (source, size, slice of the id's hash),
cells get prefix counts, and only the rows of one cell are ranked together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, unused

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and the most copies of one source.
SHARE, MOST = 1.5, 2.0
#: Hash slices of one (source, size) cell; a cell with a third of 10^9 rows keeps about 80,000 in a slice.
SLICES = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) rows, one per source -> source, source_size, target. Targets follow the weights, but no target exceeds
    `most` times its source; what is cut off is shared by weight among the rest, again and again until none is above.

    The result has a row per source; each round reads two sums over them, never the rows."""
    ranked = sizes.withColumn("rk", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rk") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("w", weight).drop("rk")
    goal = F.col("source_size") * most
    total = w.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while total:
        sums = w.agg(F.sum(F.when(~capped, F.col("w"))), F.sum(F.when(capped, goal)), F.count_if(capped)).first()
        if not sums[0]:
            break
        level = (share * total - (sums[1] or 0.0)) / sums[0]
        grown = goal < F.col("w") * level
        if w.agg(F.count_if(grown)).first()[0] == sums[2]:
            break
        capped = grown
    return w.withColumn("target", F.when(goal < F.col("w") * level, goal).otherwise(F.col("w") * level)).drop("w")


def systematic_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies, taken (copies * size).

    Null text has size 0; a source of only empty documents has target 0 and is not taken. Null is a source of its own, after
    the others. Repeated rows are separate documents, ranked as their ids' hash and then arbitrarily among equals (which one
    of two equal rows gets the extra copy cannot be told apart). No rows give no rows. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % SLICES)
    rows = materialize(rows)  # ids and sizes, not texts: read by the counts and again by the ranks
    cells = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    per_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = materialize(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    targets = source_targets(per_source, weights, share, most)
    # Prefix counts in two steps: over the sizes of a source, then over the slices of a size.
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = per_size.withColumn("before_size", F.coalesce(F.sum("n").over(by_size), F.lit(0))).drop("n")
    placed = (
        cells.withColumn("before_slice", F.coalesce(F.sum("n").over(by_slice), F.lit(0))).drop("n")
        .join(sizes.withColumnsRenamed({"source": "s1", "size": "z1"}), F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1"))).drop("s1", "z1")
        .join(targets.withColumnsRenamed({"source": "s2"}), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        .select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("slice").alias("c3"), (F.col("before_size") + F.col("before_slice")).alias("before"), "source_size", "target")
    )
    in_cell = Window.partitionBy("source", "size", "slice").orderBy("key", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell)).join(placed, F.col("source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3")) & (F.col("slice") == F.col("c3")))
    i = F.col("before") + F.col("rank")
    rate = F.col("target") / F.col("source_size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.when(F.col("source_size") > 0, F.floor(i * rate + offset) - F.floor((i - 1) * rate + offset)).otherwise(F.lit(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, columns unchanged.

    Rows are matched to their copies by id, source and size, and by their number among such rows: of rows that only differ in their
    text the one of least text hash gets most copies, so reruns agree. Null ids, sources and texts count as such; no rows give none."""
    nth, size, copy = (unused(docs, c) for c in ("nth", "size", "copy"))
    numbered = lambda d, order: d.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(order)))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    left = numbered(docs.withColumn(size, words), F.xxhash64("text")).alias("l")
    taken = systematic_mix(docs, seed=seed).filter("copies > 0").select("doc_id", "source", F.col("size").alias(size), F.col("copies").alias(copy))
    right = numbered(taken, F.desc(copy)).alias("r")
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in ("doc_id", "source")] + [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (size, nth)]
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"r.{copy}")))
    return left.join(right, same).select(*[F.col(f"l.`{c}`") for c in docs.columns], each.alias(copy)).drop(copy)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS goal,
        CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
t AS (SELECT sum(source_size)::DOUBLE AS total, sum(w) AS all_w FROM w),
it(k, level, capped) AS (
  SELECT 0, 1.5::DOUBLE * total / all_w, 0::BIGINT FROM t
  UNION ALL
  SELECT k + 1, (1.5::DOUBLE * (SELECT total FROM t) - (SELECT coalesce(sum(goal), 0) FROM w WHERE goal < w.w * it.level))
                / (SELECT sum(w) FROM w WHERE NOT goal < w.w * it.level),
         (SELECT count(*) FROM w WHERE goal < w.w * it.level)
  FROM it WHERE k < 100 AND (SELECT count(*) FROM w WHERE goal < w.w * it.level) > capped),
lv AS (SELECT arg_max(level, k) AS level FROM it),
g AS (SELECT source, source_size, CASE WHEN goal < w * level THEN goal ELSE w * level END AS target FROM w, lv),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS i FROM d),
c AS (SELECT r.doc_id, r.source, r.size, g.source_size, g.target,
        CASE WHEN g.source_size > 0 THEN
          floor(i * (target / source_size) + ('0x' || substr(md5('mix' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
          - floor((i - 1) * (target / source_size) + ('0x' || substr(md5('mix' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
        ELSE 0 END::BIGINT AS copies
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
