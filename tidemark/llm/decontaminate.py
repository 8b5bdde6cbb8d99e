"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index holds postings (document, position, term) of the training texts, for the terms that the test texts have, and a header row
for each document; it is written once, in the order of the scan, so building it shuffles nothing. A search counts each term's
postings and then works from the rarest terms:
- exact phrases: of each window of a test text the two rarest terms are looked up, their positions less their offsets in the window
  are intersected, and where both lists agree the window's other terms are looked up too. Matched terms that follow each other make
  stretches;
- proximity: the postings of a phrase's rarest term are joined with the other terms' postings in the cells of positions beside it.

Every list is keyed by document and place, so a frequent term or a document with very many matches is spread over the tasks as rows.
Test texts may be many: their tables are broadcast only up to a counted size and joined by a shuffle beyond it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Letters other than a-z count as word characters only outside ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Consecutive words of a window; lists that are intersected before the others; rows that may be broadcast.
WINDOW, FIRST, SMALL = 10, 2, 1 << 19


def words(text: Column | str) -> Column:
    """The words of a text in order, A-Z as a-z (null: none)."""
    lower = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table: broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def terms_of(items: DataFrame) -> DataFrame:
    """item_id, text -> item (a key of the row's id and text), item_id, size, j, term: a row for each word. Equal rows count once; rows
    without id or words have none."""
    split = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).distinct()
    return materialize(split.select(F.xxhash64("item_id", "w").alias("item"), "item_id", F.size("w").alias("size"), F.posexplode("w").alias("j", "term")))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, text -> the stored index: key (of the row), doc_id, n_words, pos, term. Each document's first row has an empty term, its
    doc_id and number of words; the others are its postings in order, with positions from 1. Only the given terms are indexed, or all.

    Null and wordless texts have a header alone. Rows that repeat an id are documents of their own, rows without id too."""
    split = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("w"))
    rows = split.select("key", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term"))
    rows = rows.select("key", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_words")], "pos", "term")
    if terms is None:
        return materialize(rows)
    wanted = materialize(terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string")))
    return materialize(rows.join(small(wanted), "term", "left_semi").select("key", "doc_id", "n_words", "pos", "term"))


def headers(index: DataFrame) -> DataFrame:
    return index.filter("pos = 0").select("key", "doc_id", "n_words")


def postings(index: DataFrame) -> DataFrame:
    return index.filter("pos > 0").select("key", "pos", "term")


def frequencies(index: DataFrame) -> DataFrame:
    """term -> how often it occurs: counted in each task before the shuffle."""
    return materialize(postings(index).groupBy("term").agg(F.count("*").alias("n")))


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where words of a test text (rows of terms_of) stand in a document in their order without a gap, at least `window` of them, or
    all where the test text has fewer: key, item, item_id, first, last (positions in the document), j (the first word's number in
    the test text). A stretch is as long as the words agree."""
    every = postings(index)
    counted = materialize(terms.join(small(frequencies(index)), "term", "left"))
    length = F.least(F.col("size"), F.lit(window))
    placed = counted.withColumn("length", length).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("length") + 1), F.least(F.col("j"), F.col("size") - F.col("length")))))
    own = Window.partitionBy("item", "start")
    rank = F.row_number().over(own.orderBy("n", "j"))
    picks = placed.withColumn("known", F.count("n").over(own)).withColumn("r", rank).filter(f"known = length AND r <= {FIRST}")
    picks = materialize(picks.select("item", "start", "length", "j", "term"))
    met = every.join(small(picks), "term").groupBy("key", "item", "start", "length", (F.col("pos") - F.col("j")).alias("shift")).agg(F.count("*").alias("lists"))
    both = materialize(met.filter(F.col("lists") == F.least(F.col("length"), F.lit(FIRST))).select("key", "item", "shift", "start", "length"))
    asked = both.select("key", "item", "shift", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("j")).distinct()
    asked = asked.join(small(terms), ["item", "j"]).select("key", (F.col("shift") + F.col("j")).alias("pos"), "term", "item", "item_id", "size", "j")
    keys = materialize(both.select("key").distinct())
    found = every.join(small(keys), "key", "left_semi").join(asked, ["key", "pos", "term"])
    # Matched words that follow each other: their numbers less their ranks agree.
    shift = F.col("pos") - F.col("j")
    run = F.col("j") - F.row_number().over(Window.partitionBy("key", "item", shift).orderBy("j"))
    found = found.withColumn("shift", shift).withColumn("run", run)
    stretch = found.groupBy("key", "item", "item_id", "size", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("j").alias("j"))
    return stretch.filter(F.col("last") - F.col("first") + 1 >= F.least(F.col("size"), F.lit(window))).select("key", "item", "item_id", "first", "last", "j")


def proximity_matches(index: DataFrame, terms: DataFrame, span: int = 20) -> DataFrame:
    """Where all different words of a test text lie within `span` consecutive words of a document, in any order: key, item, item_id,
    first, last. For each occurrence of the test text's rarest word that lies in such a stretch, the shortest one (ties: the
    first) that holds it."""
    every = postings(index)
    need = terms.select("item", "item_id", "term").distinct().join(small(frequencies(index)), "term", "left")
    own = Window.partitionBy("item")
    need = need.withColumn("all", F.count("*").over(own)).withColumn("known", F.count("n").over(own)).withColumn("r", F.row_number().over(own.orderBy("n", "term"))).filter(f"known = all AND all <= {span}")
    need = materialize(need.select("item", "item_id", "term", "all", "r"))
    # The rarest word's places, each in the cells around it; the others' postings, each in its own.
    rare = every.join(small(need.filter("r = 1")), "term").select("key", "item", "item_id", "all", F.col("pos").alias("at"))
    cells = rare.withColumn("cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("at") / span) + d)))
    others = every.join(small(need.filter("r > 1").select("item", "term", "r")), "term").select("key", "item", F.floor(F.col("pos") / span).alias("cell"), "pos", "r")
    near = cells.join(others, ["key", "item", "cell"]).filter(F.abs(F.col("pos") - F.col("at")) < span)
    # At most 2 span - 2 words stand near one place.
    group = near.groupBy("key", "item", "item_id", "all", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("seen"))
    alone = rare.filter("all = 1").select("key", "item", "item_id", F.col("at").alias("first"), F.col("at").alias("last"))
    seen = F.concat(F.col("seen"), F.array(F.struct(F.col("at").alias("pos"), F.lit(1).alias("r"))))
    group = group.filter(F.size(F.array_distinct(F.transform("seen", lambda x: x["r"]))) + 1 == F.col("all")).withColumn("seen", seen)
    begins = F.array_distinct(F.filter(F.transform("seen", lambda x: x["pos"]), lambda s: (s <= F.col("at")) & (s > F.col("at") - span)))
    end = lambda s: F.array_max(F.transform(F.sequence(F.lit(1), F.col("all").cast("int")), lambda t: F.coalesce(F.array_min(F.transform(F.filter("seen", lambda x: (x["r"] == t) & (x["pos"] >= s)), lambda x: x["pos"])), F.lit((1 << 31) - 1))))
    best = F.array_min(F.transform(begins, lambda s: F.struct((F.greatest(end(s), F.col("at")) - s).alias("wide"), s.alias("first"))))
    hit = group.withColumn("best", best).filter(F.col("best.wide") < span)
    return hit.select("key", "item", "item_id", F.col("best.first").alias("first"), (F.col("best.first") + F.col("best.wide")).alias("last")).unionByName(alone)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), item_ids (of the items with such windows, as sorted strings) for
    every row of docs.

    A window: `window` consecutive words of an item, or all of a shorter one. Null, empty and wordless texts have no words and no
    hits. Rows that repeat an id are documents of their own; rows without id too. Items without id take no part; items of one id
    count once. Without items or rows nothing is hit. Other columns are ignored."""
    terms = terms_of(items)
    index = build_index(docs, terms)
    found = materialize(phrase_matches(index, terms, window))
    # Stretches of one document overlap: each adds the words beyond the furthest end so far.
    before = F.max("last").over(Window.partitionBy("key").orderBy("first", "last", "item", "j").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(0))))
    hits = found.withColumn("added", added).groupBy("key").agg(F.sum("added").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))  # at most all item ids
    got = headers(index).join(hits, "key", "left")
    return got.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op13(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
hit AS (SELECT k, s, dw.n, item_id FROM (SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM dw) dw JOIN win ON dw.n = win.n AND dw.phrase = win.phrase),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
ids AS (SELECT k, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN ids USING (k)
"""
