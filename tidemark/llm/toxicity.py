"""Toxicity: a noisy-channel decoder undoes leetspeak, spacing and repetition, then the restored text is scored.

Words that the channel may have changed (digits or symbols between letters, letters three or more times in a row, runs of
single letters, leetspeak among them) become lattices of what each character may have been, a space nothing or a word's end;
Viterbi picks the likeliest reading under a character trigram model counted over the whole corpus. A run of single letters is read once without and once with word ends. Any other
word has one reading, itself. A document's evidence is a falling sum of its strongest words, each as strong as its best term:
terms are words and word beginnings that the labelled rows prove to be signs of toxicity, weighted by their log odds. A logistic
curve, fitted with every row's own counts left out, turns evidence into a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Hasher, bounded_batches, fold, materialize, runs, slices, text_buffers, unused

#: What a character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that may stand between the letters of a word.
FILLERS = ".-_*~'#%&^/\\"
#: Channel costs in nats: a substituted, dropped or repeated character, and a character read as it is though it is no letter;
#: and what a word's end in a run of single letters costs, in each of its readings.
SUBSTITUTE, DROP, DROP_LEET, REPEAT, ODD, ENDS = 1.0, 1.5, 5.0, 1.0, 9.0, (np.inf, 4.0, 2.0, 0.0)
#: Buckets of the term table, lengths in bytes of word beginnings, factors of the strongest words, and the least root of a term's
#: likelihood-ratio statistic (a normal deviate: 4.5 is passed by chance by 3 terms in a million).
TERM_BITS, BEGINNINGS, DECAY, LOWER = 22, (4, 5, 6), np.array([1.0, 0.5, 0.25]), 4.5
#: Labelled rows that terms and curve are learned from, at most (those with the least id hashes): a bounded sample, so that
#: its ids can be broadcast and no text is shuffled.
FIT_ROWS = 40000
LETTERS = 27  # a-z and any other letter or edge
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[65:91] = _WORD_BYTES[97:123] = _WORD_BYTES[128:] = True
_CHANNEL = np.zeros(256, bool)  # bytes that may stand for letters or between them; an apostrophe alone is no sign of that
_CHANNEL[[ord(c) for c in "".join(LEET) + FILLERS if ord(c) < 128 and c != "'"]] = True
_LEET = np.zeros(256, bool)  # bytes that may stand for letters
_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True
#: Plain punctuation around a word. At the word's edges within it, these may stand for a letter ('!' and '+' not at the end).
_BEFORE, _AFTER, _FIRST, _LAST = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"\"'([{<.,;:-_*~#", b"\"')]}>.,;:!?-_*~#", b"0123456789@$!|+", b"0123456789@$|"))
_MONEY = ((0xE2, 0x82, 0xAC), (0xC2, 0xA3))  # the signs of LEET that have several bytes
_KIND = np.full(256, 26)
_KIND[65:91] = _KIND[97:123] = np.arange(26)


# --- the character model -------------------------------------------------------------------------------------------------
def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of letter kinds (a-z, other) within every text: none reaches from one text into the next, so the counts do not
    depend on how the rows are dealt. Each task sends its 27^3 counts, no text."""

    def count(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                x = _KIND[data[offsets[i] : offsets[j]]]
                if len(x) > 2:
                    inside = np.ones(len(x), bool)
                    ends = offsets[i + 1 : j + 1] - offsets[i]
                    for back in (1, 2):  # the last two places of a text begin no trigram
                        inside[ends[ends >= back] - back] = False
                    total += np.bincount(((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:])[inside[:-2]], minlength=LETTERS**3)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.flatnonzero(total), pa.int32()), "n": pa.array(total[total > 0], pa.int64())})

    got = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LETTERS**3)
    out[got["k"]] = got["n"]
    return out


def char_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first, second), smoothed with the bigram and the uniform distribution."""
    c3 = counts.reshape(LETTERS, LETTERS, LETTERS)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 1) / (c2.sum() + LETTERS)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return -np.log(p3)


def _readings(token: str, end: float) -> list[list[tuple[str, float]]]:
    """The lattice: for each character of the token its readings ('' drops it) and their channel costs."""
    out = []
    low = token.lower()
    for i, c in enumerate(low):
        if c.isalpha():
            again = i > 0 and low[i - 1] == c
            tripled = again and (i > 1 and low[i - 2] == c or i + 1 < len(low) and low[i + 1] == c)
            out.append([(c, REPEAT if tripled else 0.0), *([("", 0.0)] if tripled else [])])
        else:
            read = [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            if c == " ":
                out.append([("", 0.0), *([(c, end)] if end < np.inf else [])])
                continue
            alone = c in LEET and i > 0 and low[i - 1] == " " and low[i + 1 : i + 2] == " "  # in a letter's place
            out.append([*read, ("", ODD if alone else DROP if c in FILLERS or i + 1 == len(low) and c in "!(|+" else DROP_LEET), (c, ODD)])
    return out


def restore(token: str, costs: np.ndarray, end: float = np.inf) -> str:
    """The likeliest reading of one token (Viterbi; the state is the last two letters kept); `end`: cost of a word's end at a space."""
    kind = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(26, 26): (0.0, ())}
    for choices in _readings(token, end):
        nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in beam.items():
            for letter, extra in choices:
                if letter:
                    k = kind(letter)
                    state, total, way = (b, k), cost + extra + costs[a, b, k], (path, letter)
                else:
                    state, total, way = (a, b), cost + extra, path
                if state not in nxt or total < nxt[state][0]:
                    nxt[state] = (total, way)
        beam = nxt
    best = min(((cost + costs[a, b, 26], path) for (a, b), (cost, path) in beam.items()), key=lambda x: x[0])[1]
    out = []
    while best:
        best, letter = best
        out.append(letter)
    return "".join(reversed(out))


def _core(starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, last: bool) -> np.ndarray:
    """Position of each token's first (last) byte that is not plain; of its first byte if all are."""
    where = np.flatnonzero(~plain)
    if not len(where):
        return starts
    at = where[np.clip(np.searchsorted(where, ends, "left") - 1 if last else np.searchsorted(where, starts, "left"), 0, len(where) - 1)]
    return np.where((at >= starts) & (at < ends), at, starts)


def suspects(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
    """(row, stretch): tokens with a channel sign between letters, one that may be a letter at an edge (punctuation around the
    word aside), or a letter three times in a row; and runs of three or more single letters or signs that may be letters, at
    least one of them a letter, joined with single spaces."""
    starts, ends, rows = runs(data, offsets, ~SPACE)
    if not len(starts):
        return []
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    letter, sign = _WORD_BYTES[data], _CHANNEL[data]
    before, after, money = _BEFORE[data], _AFTER[data], np.zeros(len(data), bool)
    for code in _MONEY:
        if len(data) >= len(code):
            at = np.flatnonzero(np.logical_and.reduce([data[i : len(data) - len(code) + 1 + i] == c for i, c in enumerate(code)]))
            for i in range(len(code)):
                money[at + i] = True
    letter, sign = letter & ~money, sign | money
    letters = np.concatenate([[0], np.cumsum(letter)])
    signs = np.concatenate([[0], np.cumsum(sign)])
    count = letters[ends] - letters[starts]
    some = np.flatnonzero(count > 0)
    where = np.flatnonzero(letter)
    first, last = where[letters[starts[some]]], where[letters[ends[some]] - 1]
    odd = np.zeros(len(starts), bool)
    odd[some] = signs[last] - signs[first] > 0
    head, tail = _core(starts, ends, before, False), _core(starts, ends, after, True)
    odd |= (count >= 1) & (tail - head >= 2) & (_FIRST[data[head]] | _LAST[data[tail]] | money[head] | money[tail])
    triple = np.flatnonzero(letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)) + 2
    odd[np.searchsorted(starts, triple, "right") - 1] = True
    out = [(int(row[k]), data[starts[k] : ends[k]].tobytes()) for k in np.flatnonzero(odd)]
    leet = (count == 0) & (_LEET[data[starts]] & ((ends - starts == 1) | (ends - starts == 2) & after[ends - 1]) | money[starts] & money[ends - 1] & (ends - starts <= 3))
    single = (count == 1) & (ends - starts <= 2) | leet
    change = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for a, b in zip(change[::2], change[1::2], strict=True):
        for k in np.split(np.arange(a, b), np.flatnonzero(np.diff(row[a:b])) + 1):
            if len(k) >= 3 and count[k].any():
                out.append((int(row[k[0]]), b" ".join(data[starts[k[0]] : ends[k[-1]]].tobytes().split())))
    return out


class Restorer:
    """Restored forms of suspicious stretches; equal stretches are decoded once."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.one = costs, lru_cache(1 << 16)(self.read)

    def read(self, stretch: bytes) -> str:
        """The reading of a token; the distinct words of all readings of a run of single letters."""
        text = stretch.decode("utf-8", "replace")
        return " ".join(dict.fromkeys(w for end in (ENDS if " " in text else ENDS[:1]) for w in restore(text, self.costs, end).split()))

    def added(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Per row the restored stretches, parted by spaces."""
        out: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
        for row, token in suspects(data, offsets):
            out[row].append(self.one(token))
        return [" ".join(x) for x in out]


# --- terms ---------------------------------------------------------------------------------------------------------------
def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the buckets of itself and of its beginnings (itself again where it is too short), and its row."""
    starts, ends, rows = runs(data, offsets, _WORD_BYTES)
    h, row = Hasher(data), np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    own = h.of(starts, ends)
    parts = [own]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n + 1)
        part = own.copy()
        part[long] = h.of(starts[long], starts[long] + n) + np.uint64(n)
        parts.append(part)
    return (np.stack(parts, 1) >> np.uint64(64 - TERM_BITS)).astype(np.int32), row


def _batch_terms(texts: pa.Array, restorer: Restorer):
    """For each slice of rows: first row, rows, buckets and owners, each (row, bucket) once, restored words included."""
    data, offsets = text_buffers(texts)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        t, r = _terms(part, at)
        extra = restorer.added(part, at)
        if any(extra):
            t2, r2 = _terms(*text_buffers(pa.array(extra, pa.large_string())))
            t, r = np.concatenate([t, t2]), np.concatenate([r, r2])
        yield i, j - i, t, r


@dataclass
class ToxicModel:
    costs: np.ndarray
    weights: np.ndarray  # float32, one for each bucket; 0 for terms that prove nothing
    slope: float
    shift: float


def _weights(toxic, clean, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of a term in toxic against clean rows; 0 unless they are positive and the root of its likelihood-ratio
    statistic reaches LOWER. How much weak terms prove is left to the curve."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))
    share, seen = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0), toxic + clean
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(seen * p, 1e-9)), 0.0)
    root = np.sqrt(np.maximum(0, 2 * (part(toxic, share) + part(clean, 1 - share))))
    return np.where((odds > 0) & (root >= LOWER), odds, 0.0)


def _evidence(weights: np.ndarray, t: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """A word weighs as its best term; each row's strongest distinct words count with the factors DECAY."""
    w = weights[t].max(1) if len(t) else np.zeros(0)
    hit = w > 0
    out = np.zeros(n)
    t, r, w = t[hit, 0], r[hit], w[hit]
    order = np.lexsort((t, -w, r))
    t, r, w = t[order], r[order], w[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    r, w = r[new], w[new]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    top = place < len(DECAY)
    np.add.at(out, r[top], w[top] * DECAY[place[top]])
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out=None) -> ToxicModel:
    """Counts every text for the character model, and up to FIT_ROWS labelled rows outside the held-out fold for the terms. To
    the driver come 27^3 character counts, the term buckets that toxic rows hold (2^22 at most), and rounded evidences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = fold("doc_id", 5) == 0 if held_out is None else held_out
    costs = char_costs(char_counts(docs))
    lab = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    lab = materialize(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("text", "y")  # FIT_ROWS ids at most
    shared = spark.sparkContext.broadcast(costs)  # 27^3 numbers

    def count(batches):
        restorer, total, sums = Restorer(shared.value), np.zeros((2, 1 << TERM_BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False) > 0
            sums += [int((~y).sum()), int(y.sum())]
            for i, n, t, r in _batch_terms(batch.column(0), restorer):
                u = np.unique(((r << TERM_BITS)[:, None] | t).ravel())
                own, bucket = y[i + (u >> TERM_BITS)], u & ((1 << TERM_BITS) - 1)
                for k in (0, 1):
                    b, c = np.unique(bucket[own == k], return_counts=True)
                    total[k][b] += c.astype(np.int32)
        for k in (0, 1):
            b = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_pydict({"y": pa.array(np.full(len(b) + 1, k), pa.int32()), "b": pa.array(np.append(b, -1), pa.int32()), "n": pa.array(np.append(total[k][b], sums[k]), pa.int64())})

    counted = rows.mapInArrow(count, "y int, b int, n long").groupBy("b").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    got = counted.filter("toxic > 1 OR b = -1").toPandas()
    all_rows = got[got["b"] == -1]
    n_toxic, n_clean = (int(all_rows["toxic"].sum()), int(all_rows["clean"].sum()))
    got = got[got["b"] >= 0]
    b, toxic, clean = got["b"].to_numpy(), got["toxic"].to_numpy(float), got["clean"].to_numpy(float)
    weights = np.zeros(1 << TERM_BITS, np.float32)
    weights[b] = _weights(toxic, clean, n_toxic, n_clean)
    # Weights with one toxic or one clean row less: what a labelled row sees if it is left out.
    without = [np.zeros(1 << TERM_BITS, np.float32) for _ in (0, 1)]
    without[1][b] = _weights(toxic - 1, clean, max(0, n_toxic - 1), n_clean)
    without[0][b] = _weights(toxic, np.maximum(0, clean - 1), n_toxic, max(0, n_clean - 1))
    less = spark.sparkContext.broadcast(without)  # 2 tables of 2^22 floats

    def evidences(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False) > 0
            x = np.zeros(len(y))
            for i, n, t, r in _batch_terms(batch.column(0), restorer):
                own = y[i : i + n]
                x[i : i + n] = np.where(own, _evidence(less.value[1], t, r, n), _evidence(less.value[0], t, r, n))
            yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": pa.array(y.astype(np.int32))})

    pairs = rows.mapInArrow(evidences, "x double, y int").groupBy(F.round("x", 2).alias("x")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).toPandas()
    return ToxicModel(costs, weights, *_logistic(pairs["x"].to_numpy(float), pairs["p"].to_numpy(float), pairs["n"].to_numpy(float)))


def _logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a small ridge, a step halved until the loss falls (whole steps may swing for
    ever); without rows a curve that stays below one half at 0."""
    a, c = 1.0, -2.0
    if not n.sum() or not 0 < p.sum() < n.sum():
        return a, c
    loss = lambda a, c: (n * np.logaddexp(0, a * x + c) - p * (a * x + c)).sum() + 0.005 * a * a
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        v = n * s * (1 - s)
        g = np.array([((p - n * s) * x).sum() - 0.01 * a, (p - n * s).sum()])
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        now = loss(a, c)
        while loss(a + step[0], c + step[1]) > now and np.abs(step).max() >= 1e-9:
            step = step / 2
        a, c = a + step[0], c + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(c)


def _scorer(spark, model: ToxicModel):
    shared = spark.sparkContext.broadcast(model)  # one table of 2^22 floats and 27^3 costs

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        restorer, out = Restorer(m.costs), np.zeros(len(texts))
        for i, n, t, r in _batch_terms(pa.array(texts, pa.large_string(), from_pandas=True), restorer):
            out[i : i + n] = _evidence(m.weights, t, r, n)
        return pd.Series(1 / (1 + np.exp(-np.clip(m.slope * out + m.shift, -30, 30))))

    return score


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. The evidence of a text is that of its strongest different words: the first whole, the
    second half, the third a quarter (DECAY), so that length alone raises no score. Null and empty texts hold no term and get the
    score of no evidence; repeated rows are repeated; other columns are ignored. No rows, no scores."""
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), _scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below one half, columns unchanged. Null and empty texts stay, repeated rows stay as they are; without labelled
    rows, or labels of one kind only, nothing tells toxic texts apart. No rows give none."""
    model = fit(docs, labels)
    found = unused(docs, "found")
    return docs.withColumn(found, _scorer(docs.sparkSession, model)(F.col("text"))).filter(F.col(found) < 0.5).drop(found)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
