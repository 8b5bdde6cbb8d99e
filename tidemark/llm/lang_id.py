"""Language identification: averaged hashed character n-gram embeddings under a linear softmax, trained by stochastic
gradient descent in numpy, with a temperature and a rejection level set on rows kept from training.

Since averaging and the softmax layer are linear, prediction folds embedding and output matrix into one table of logits per
hash bucket: a document's logits are the mean of its n-grams' rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, fold, mix, unused

#: Hash buckets, embedding width, n-gram lengths.
BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
#: Labelled documents fitted on, at most, for each language (the least hashes of their ids) and in all, and their characters in all:
#: each brings its equal share of them at most (or LEAST), from its beginning. Many languages get fewer documents each; none is left
#: out. The driver holds about 24 bytes for each of these characters while it fits.
PER_LANG, FIT_ROWS, FIT_CHARS, LEAST = 1200, 24_000, 1 << 22, 256
#: Characters hashed at a time.
SLICE = 1 << 17


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything but letters becomes one space (0 at both ends)."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((x >= 97) & (x <= 122)) | ((x >= 0xAA) & (x != 0xD7) & (x != 0xF7) & ((x < 0x2000) | (x > 0x2BFF)) & ((x < 0x3000) | (x > 0x3040)))
    x = np.where(letter, x, 32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return np.concatenate([[32], x[keep], [32]]).astype(np.uint64)


def _features(codes: np.ndarray, seen: int = 0) -> np.ndarray:
    """Bucket of every n-gram of all orders, but for those within the first `seen` codes."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            out.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32)[max(0, seen - n + 1) :])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _logits(model: LangModel, text: str) -> np.ndarray:
    total, n, k = np.zeros(len(model.langs)), 0, max(ORDERS) - 1
    codes = _codes(text)
    counts = np.zeros(BUCKETS, np.int64) if len(codes) > SLICE else None
    for i in range(0, len(codes), SLICE):
        f = _features(codes[max(0, i - k) : i + SLICE], min(i, k))
        n += len(f)
        if counts is None:
            total += model.table[f].sum(0, dtype=np.float64)
        else:
            counts += np.bincount(f, minlength=BUCKETS)
    if counts is not None:
        total = counts @ model.table.astype(np.float64)
    return total / max(n, 1) + model.bias


def predict(model: LangModel, text: str | None) -> tuple[str, float, bool]:
    """Language, calibrated probability, rejected. Null or letterless text: ('und', 0.0, True)."""
    if text is None or not _has_letter(text) or not model.langs:
        return "und", 0.0, True
    z = _logits(model, text) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    i = int(p.argmax())
    return model.langs[i], float(p[i]), bool(p[i] < model.reject)


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 4, rate: float = 8.0) -> LangModel:
    """rows: (text, language). One row in five is kept to set the temperature and the rejection level (the confidence that
    one in a thousand of them stays below, at most 0.5). Besides whole texts it learns from snippets of 1 to 12 words, so that
    short texts are not strange to it. No rows: a model that answers 'und'."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    if not langs:
        return LangModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    train, held = [], []
    for k, (text, lang) in enumerate(rows):
        y, words = langs.index(lang), text.split()
        pieces = [text]
        for _ in range(3):
            if words:
                a, n = int(rng.integers(len(words))), int(rng.integers(1, 13))
                pieces.append(" ".join(words[a : a + n]))
        for piece in pieces if k % 5 else [text]:
            if _has_letter(piece):
                f, c = np.unique(_features(_codes(piece)), return_counts=True)
                (train if k % 5 else held).append((f, (c / c.sum()).astype(np.float32), y, piece))
    emb = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    out = np.zeros((WIDTH, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps, t = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            f, c, y, _ = train[k]
            lr = rate * (1 - t / steps)
            t += 1
            x = c @ emb[f]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * 0.1 * np.outer(x, p)
            bias -= lr * 0.001 * p
            emb[f] -= (lr * c)[:, None] * back
    model = LangModel(langs, (emb @ out).astype(np.float32), bias.astype(np.float64))
    if held:
        z = np.array([_logits(model, piece) for *_, piece in held])
        y = np.array([h[2] for h in held])

        def loss(t: float) -> float:
            s = z / t
            s -= s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        model.reject = float(min(0.5, np.quantile((p / p.sum(1, keepdims=True)).max(1), 0.001)))
    return model


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, held_out=None) -> list[tuple[str, str]]:
    """At most per_lang labelled documents of each language, those with the least id hashes outside the held-out fold. First
    ids alone are chosen (with a limit before the shuffle), then their texts are fetched: at most FIT_ROWS rows, or one for each
    language, and FIT_CHARS characters in all. Long texts are cut for the fit, not left out."""
    held_out = fold("doc_id", 4) == 2 if held_out is None else held_out
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    counts = known.groupBy("lang").count()
    langs = max(1, counts.count())
    per_lang = max(1, min(per_lang, FIT_ROWS // langs))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))  # uniform in [0, 1)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    # A language's share of places that holds about twice the rows wanted, so that no language gathers in one task.
    sizes = F.broadcast(counts) if langs <= FIT_ROWS else counts  # a row for each language, counted
    near = known.select("doc_id", "lang", place.alias("place")).join(sizes, "lang").filter(F.col("place") * F.col("count") < 2 * per_lang + 100)
    chosen = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang).select("doc_id").distinct().limit(langs * per_lang)
    # The bound on the broadcast side is FIT_ROWS ids, or one for each language.
    most = max(LEAST, FIT_CHARS // (langs * per_lang))
    got = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.substring("text", 1, most).alias("text"), "lang").dropDuplicates(["doc_id"])
    return [(r.text, r.lang) for r in sorted(got.toLocalIterator(), key=lambda r: r.doc_id)]


def _predictor(model: LangModel):
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(model, t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LangModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; repeated rows are repeated. Null or letterless text is
    'und' with score 0 and rejected. lang, source and doc_id never reach a prediction. Other columns are ignored."""
    bounded_batches(docs.sparkSession)
    model = model or fit(training_rows(docs))
    got = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), _predictor(model)(F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_known(docs: DataFrame, model: LangModel | None = None) -> DataFrame:
    """The rows whose language is not rejected, columns unchanged. Null and letterless texts go; repeated rows stay as they are; no rows give
    none, and a table without labelled rows is judged by a model that knows no language."""
    bounded_batches(docs.sparkSession)
    model = model or fit(training_rows(docs))
    found = unused(docs, "found")
    return docs.withColumn(found, _predictor(model)(F.col("text"))).filter(~F.col(found)["rejected"]).drop(found)


def op8(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
