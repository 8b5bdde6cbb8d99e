"""Stupid-backoff scores of every document under n-gram counts of the whole corpus, its own counts left out.

Relations, all keyed by hashes of n-grams:
- chunks: a run of documents as word numbers of the chunk's own vocabulary (written once to the shared folder);
- exploded n-grams: per chunk and hash bucket, the distinct n-grams of each order with their counts in the chunk;
- count tables: per bucket, the sum over chunks (one task holds one bucket, a fixed share of all distinct n-grams; a frequent
  n-gram is a single entry of each chunk);
- the join: each bucket answers every chunk with the corpus counts of its n-grams, in the chunk's order, so that no key
  travels back; a chunk and its answers give each document's sum.
Keys and counts travel as sorted, differenced and compressed columns in a row for each chunk and bucket: a row for each n-gram
would move about four times the bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ngram_hashes, shared_dir, slices, text_buffers, word_hashes

#: Longest n-gram, factor of each step back, bytes of text in a chunk, hash buckets for each shuffle partition.
ORDER, ALPHA, CHUNK, BUCKETS_EACH = 3, 0.4, 8 << 20, 4
#: Bits of an n-gram's key: of 10^12 distinct n-grams about one in 70,000 shares its key with another.
KEY_BITS = 56


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _chunks(batches):
    """doc_id, text -> chunk, n_words, ids, sizes, vocab, seq."""
    first, k = TaskContext.get().partitionId() << 32, 0
    ids, sizes, words, held = [], [], [], 0

    def out():
        every = np.concatenate(words) if words else np.zeros(0, np.uint64)
        vocab, seq = np.unique(every, return_inverse=True)
        delta = np.diff(vocab, prepend=np.uint64(0))
        row = [[first + k], [len(every)], [ids], [np.concatenate(sizes).tolist()], [pack(delta)], [pack(seq.astype(np.uint32))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=["chunk", "n_words", "ids", "sizes", "vocab", "seq"])

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets):
            w, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = ids + batch.column(0).slice(i, j - i).to_pylist()
            sizes.append(np.diff(rows))
            words.append(w)
            held += int(offsets[j] - offsets[i])
            if held >= CHUNK:
                yield out()
                k += 1
                ids, sizes, words, held = [], [], [], 0
    if ids:
        yield out()


def _grams(vocab: bytes, seq: bytes, sizes, order: int):
    """For each n up to order: sorted distinct hashes, the index among them of the n-gram at each valid place, those places."""
    sizes = np.asarray(sizes, np.int64)
    words = np.cumsum(unpack(vocab, np.uint64))[unpack(seq, np.uint32)] if sizes.sum() else np.zeros(0, np.uint64)
    left = np.repeat(np.cumsum(sizes).astype(np.int32), sizes) - np.arange(len(words), dtype=np.int32)  # words to the document's end
    for n in range(1, order + 1):
        place = np.flatnonzero(left >= n).astype(np.int32)
        keys, index = np.unique(ngram_hashes(words, n)[place] >> np.uint64(64 - KEY_BITS), return_inverse=True)
        yield keys, index.astype(np.int32), place


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin; buckets are ranges of the hash."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**KEY_BITS / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _exploded(order: int, buckets: int):
    kinds = [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]

    def run(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                keys, counts = [[] for _ in range(buckets)], [[] for _ in range(buckets)]
                for u, index, _ in _grams(row["vocab"], row["seq"], row["sizes"], order):
                    c, cut = np.bincount(index, minlength=len(u)).astype(np.uint32), _cuts(u, buckets)
                    for b in range(buckets):
                        own = u[cut[b] : cut[b + 1]]
                        keys[b].append(pack(np.diff(own, prepend=np.uint64(0))))
                        counts[b].append(pack(c[cut[b] : cut[b + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip((range(buckets), [row["chunk"]] * buckets, keys, counts), kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: its count table, and for every chunk the table's counts of the chunk's n-grams."""
    out = [[] for _ in range(len(pdf))]
    for n in range(len(pdf["keys"].iloc[0])):
        keys = [np.cumsum(unpack(k[n], np.uint64), dtype=np.uint64) for k in pdf["keys"]]
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        table = np.bincount(index, weights=np.concatenate([unpack(c[n], np.uint32) for c in pdf["counts"]])) if len(index) else np.zeros(0)
        at = np.cumsum([0, *map(len, keys)])
        for k in range(len(pdf)):
            out[k].append(pack(table[index[at[k] : at[k + 1]]].astype(np.uint64)))
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "answer": out})


def _scores(order: int, total: int):
    def run(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        sizes = np.asarray(row["sizes"], np.int64)
        words, docs = int(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)
        answers = answers.sort_values("bucket")
        counts = []  # for each n: count in other documents of the n-gram that begins at each word (0 where none does)
        for n, (keys, index, place) in enumerate(_grams(row["vocab"], row["seq"], sizes, order)):
            whole = np.concatenate([unpack(a[n], np.uint64) for a in answers["answer"]]).astype(np.int64)
            pair = docs[place] * np.int64(len(keys)) + index
            _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
            c = np.zeros(words, np.int64)
            c[place] = whole[index] - own[inverse]
            counts.append(c)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, behind = np.arange(words), np.arange(words) - first  # words before each word in its document
        rest = np.maximum(total - sizes[docs], 1).astype(np.float64) if words else np.zeros(0)
        top = np.minimum(behind + 1, order)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(counts[0] > 0, counts[0], 0.5) / rest * ALPHA ** (top - 1)
            used = np.where(counts[0] > 0, 1, 0)
            for n in range(2, order + 1):
                start = np.maximum(i - n + 1, 0)
                hit = (top >= n) & (counts[n - 1][start] > 0)
                value = np.where(hit, counts[n - 1][start] / counts[n - 2][start] * ALPHA ** (top - n), value)
                used = np.where(hit, n, used)
        micro = np.floor(np.log(value) * 1e6 + 0.5).astype(np.int64)
        sums = lambda x: np.bincount(docs, x, minlength=len(sizes)).astype(np.int64)  # noqa: E731  (exact below 2^53)
        out = {"doc_id": pd.array([None if d is None or d != d else int(d) for d in row["ids"]], dtype="Int64"), "n_words": sizes, "log_micro": sums(micro)}
        for n in range(order + 1):
            out[f"by_order_{n}"] = sums(used == n)
        return pd.DataFrame(out)

    return run


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table bucketed by the key in the shared folder, so that grouping by it later moves nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = f"chunks_{path[-32:]}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_micro, score, by_order_0 ... by_order_<order> for every row.

    Words are runs of non-white-space with A-Z lower-cased. A word's value is count(n-gram) / count(n-gram without it) for the
    longest n-gram ending in it that occurs outside the document (all counts without the document's own), times ALPHA for
    each order given up; at order 1 the divisor is the number of words elsewhere (1 at least), and a word unknown elsewhere counts half
    (by_order_0). log_micro sums each word's natural logarithm rounded to a millionth; score is its mean. Null, empty and
    wordless texts have n_words 0, log_micro 0 and a null score. Repeated rows are separate documents, each known from the
    other. No rows, no result; other columns are ignored."""
    spark = docs.sparkSession
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _bucketed(docs.select("doc_id", "text").mapInArrow(_chunks, "chunk long, n_words long, ids array<long>, sizes array<long>, vocab binary, seq binary"), "chunk")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    asked = chunks.select("chunk", "sizes", "vocab", "seq").mapInArrow(_exploded(order, buckets), "bucket int, chunk long, keys array<binary>, counts array<binary>")
    answers = asked.groupBy("bucket").applyInPandas(_answers, "chunk long, bucket int, answer array<binary>")
    by = ", ".join(f"by_order_{n} long" for n in range(order + 1))
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scores(order, total), f"doc_id long, n_words long, log_micro long, {by}")
    return scored.withColumn("score", F.col("log_micro") / F.lit(1e6) / F.when(F.col("n_words") > 0, F.col("n_words")))


def op10(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS c, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, c, lag(c) OVER v AS b, lag(c, 2) OVER v AS a FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT *,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS c1,
    count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) AS c2,
    count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS c3,
    greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1)::DOUBLE AS rest
  FROM g),
p AS (
  SELECT *, lag(c1) OVER v AS before1, lag(c2) OVER v AS before2, least(i, 3) AS top FROM n WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id,
    CASE WHEN i >= 3 AND c3 > 0 THEN 3 WHEN i >= 2 AND c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
    CASE WHEN i >= 3 AND c3 > 0 THEN c3 / before2::DOUBLE
         WHEN i >= 2 AND c2 > 0 THEN c2 / before1::DOUBLE * pow(0.4::DOUBLE, top - 2)
         ELSE CASE WHEN c1 > 0 THEN c1::DOUBLE ELSE 0.5::DOUBLE END / rest * pow(0.4::DOUBLE, top - 1) END AS value
  FROM p),
t AS (
  SELECT doc_id, count(*) AS n_words, sum(floor(ln(value) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT)::BIGINT AS log_micro,
    count(*) FILTER (WHERE used = 0) AS by_order_0, count(*) FILTER (WHERE used = 1) AS by_order_1,
    count(*) FILTER (WHERE used = 2) AS by_order_2, count(*) FILTER (WHERE used = 3) AS by_order_3
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(log_micro, 0) AS log_micro, coalesce(by_order_0, 0) AS by_order_0,
  coalesce(by_order_1, 0) AS by_order_1, coalesce(by_order_2, 0) AS by_order_2, coalesce(by_order_3, 0) AS by_order_3,
  log_micro / 1e6::DOUBLE / nullif(n_words, 0) AS score
FROM d LEFT JOIN t USING (doc_id)
"""
