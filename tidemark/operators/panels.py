"""Metrics of panels of forecasters beside a reference price: rows (forecaster, question, round, p, ref, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clipped_logit

#: Rounds of alternating means between two writes.
TOGETHER = 4

def edges(panel: DataFrame) -> DataFrame:
    """panel with d: the reference's Brier less the forecaster's, question by question."""
    return panel.withColumn("d", F.pow(F.col("ref") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2))


def mean_edges(panel: DataFrame, by: list[str] = ("forecaster",)) -> DataFrame:
    """n, edge, brier and constant (their sum: on a balanced panel the same for everyone)."""
    g = edges(panel).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("edge"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return g.withColumn("constant", F.col("edge") + F.col("brier"))


def adjusted_effects(panel: DataFrame, value: Column, cut, rounds: int = 60, tol: float = 1e-10) -> DataFrame:
    """forecaster, alpha of value = mu + alpha(forecaster) + gamma(question), alphas with mean 0, by alternating means (each round two
    grouped joins; every few rounds are written down by `cut`), until no alpha moves by more than tol from one writing to the next."""
    d = cut(panel.select("forecaster", "question", value.alias("v")).filter("v IS NOT NULL"))
    alpha = cut(d.select("forecaster").distinct().withColumn("alpha", F.lit(0.0)))
    for _ in range(0, rounds, TOGETHER):
        last = alpha
        for _ in range(TOGETHER):  # rounds between two writes
            gamma = d.join(last, "forecaster").groupBy("question").agg(F.avg(F.col("v") - F.col("alpha")).alias("gamma"))
            last = d.join(gamma, "question").groupBy("forecaster").agg(F.avg(F.col("v") - F.col("gamma")).alias("alpha"))
        both = cut(alpha.join(last.withColumnRenamed("alpha", "new"), "forecaster"))
        moved = both.agg(F.max(F.abs(F.col("new") - F.col("alpha")))).first()[0]
        alpha = both.select("forecaster", F.col("new").alias("alpha"))
        if moved is None or moved <= tol:
            break
    mean = alpha.agg(F.avg("alpha")).first()[0] or 0.0
    return alpha.withColumn("alpha", F.col("alpha") - mean)


#: The six fits of a forecaster: questions of both halves, of the first, of the second; with the forecast beside the price, and without.
FITS = [(half, full) for half in (None, 0, 1) for full in (True, False)]
RIDGE, ROUNDS, CLOSE, KEPT = 1e-9, 60, 1e-8, 100_000  # KEPT: forecasters whose coefficients are broadcast
_STATE = "k string, n array<long>, yes array<long>, b array<array<double>>, step array<array<double>>, s array<double>, loss array<double>, done boolean"


def _logit(b: Column, f: int) -> Column:
    """The logit of fit f under its coefficients (an array for each fit)."""
    c = F.element_at(b, f + 1)
    z = c[0] + c[1] * F.col("zr")
    return z + c[2] * F.col("zf") if FITS[f][1] else z


def _gain(z: Column) -> Column:
    """A row's log-likelihood under a logit."""
    return F.col("y") * z - F.greatest(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def _newton(pdfs):
    """One step of each fit: where the loss at the tried coefficients has fallen they are taken and the next step is theirs, else half of
    the last step is tried."""
    for pdf in pdfs:
        rows = []
        for r in pdf.itertuples(index=False):
            b, step, s, loss = [list(x) for x in r.b], [list(x) for x in r.step], list(r.s), list(r.loss)
            done = True
            for f, (_, full) in enumerate(FITS):
                if not 0 < r.yes[f] < r.n[f] or s[f] == 0:
                    continue
                m = np.array(r.sums[f], float)
                tried = np.array(b[f]) + s[f] * np.array(step[f])
                now = -m[0] + RIDGE * tried @ tried
                if now <= loss[f] + 1e-10 * max(1.0, abs(now)):
                    k = 3 if full else 2
                    h = np.array([[m[4], m[5], m[6]], [m[5], m[7], m[8]], [m[6], m[8], m[9]]])[:k, :k] + 2 * RIDGE * np.eye(k)
                    g = m[1:4][:k] - 2 * RIDGE * tried[:k]
                    new = np.zeros(3)
                    new[:k] = np.linalg.lstsq(h, g, rcond=None)[0]
                    b[f], step[f], s[f], loss[f] = tried.tolist(), new.tolist(), 1.0, now
                    if np.abs(new).max() < CLOSE:
                        b[f], s[f] = (tried + new).tolist(), 0.0
                else:
                    s[f] /= 2
                    if s[f] < 1e-6:
                        s[f] = 0.0
                done &= s[f] == 0
            rows.append((r.k, list(r.n), list(r.yes), b, step, s, loss, done))
        yield pd.DataFrame(rows, columns=["k", "n", "yes", "b", "step", "s", "loss", "done"])


def contribution(panel: DataFrame, cut, by: str = "forecaster") -> DataFrame:
    """by, n, beta (the forecast's weight in the encompassing logit beside the price), dll (gain of log-likelihood per forecast over
    the price alone), dll_adj (less 1 / 2n), dll_cross (fitted on one half of the questions by their hash, scored on the other,
    averaged); null without both outcomes.

    Newton's method on sums: a round adds up gradients and curvatures of all fits over the rows, in each task before the shuffle, and
    only a row for each forecaster is solved. No forecaster's rows are gathered. cut(frame) writes a frame and reads it again."""
    z = panel.select(F.col(by).cast("string").alias("k"), clipped_logit(F.col("ref")).alias("zr"), clipped_logit(F.col("p")).alias("zf"), F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("question"), F.lit(2)).alias("half"))
    z = cut(z.filter("zr IS NOT NULL AND zf IS NOT NULL AND y IS NOT NULL"))
    of = lambda f: F.lit(True) if FITS[f][0] is None else F.col("half") == FITS[f][0]
    count = z.groupBy("k").agg(F.array(*[F.count_if(of(f)) for f in range(6)]).alias("n"), F.array(*[F.count_if(of(f) & (F.col("y") > 0)) for f in range(6)]).alias("yes"))
    flat = lambda v: F.array(*[F.lit(v)] * 6)
    zero = F.array(*[F.array(*[F.lit(0.0)] * 3)] * 6)
    state = cut(count.select("k", "n", "yes", zero.alias("b"), zero.alias("step"), flat(1.0).alias("s"), flat(float("inf")).alias("loss"), F.lit(False).alias("done")))
    small = state.count() <= KEPT
    few = lambda d: F.broadcast(d) if small else d

    def sums(f: int) -> Column:
        """Log-likelihood, gradient (3) and curvature (6) of fit f at its tried coefficients."""
        t = _logit(F.col("tried"), f)
        p = 1 / (1 + F.exp(-t))
        x = (F.lit(1.0), F.col("zr"), F.col("zf") if FITS[f][1] else F.lit(0.0))
        e, w = F.col("y") - p, p * (1 - p)
        parts = [_gain(t), *(e * v for v in x), *(w * x[i] * x[j] for i in range(3) for j in range(i, 3))]
        return F.array(*[F.coalesce(F.sum(F.when(of(f), v)), F.lit(0.0)) for v in parts])

    for _ in range(ROUNDS):
        tried = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda f: F.zip_with(F.element_at("b", f), F.element_at("step", f), lambda b, d: b + F.element_at("s", f) * d))
        open_ = state.filter("NOT done").withColumn("tried", tried)
        got = z.join(few(open_.select("k", "tried")), "k").groupBy("k").agg(F.array(*[sums(f) for f in range(6)]).alias("sums"))
        now = open_.drop("tried").join(got, "k").mapInPandas(_newton, _STATE)
        state = cut(state.filter("done").unionByName(now))
        if state.filter("NOT done").isEmpty():
            break
    # What each fit gains: those of all questions there, those of one half on the other.
    other = lambda f: F.lit(True) if FITS[f][0] is None else F.col("half") != FITS[f][0]
    scored = z.join(few(state.select("k", "b")), "k").groupBy("k").agg(*[F.sum(F.when(other(f), _gain(_logit(F.col("b"), f)))).alias(f"l{f}") for f in range(6)])
    both = lambda f: (F.col("yes")[f] > 0) & (F.col("yes")[f] < F.col("n")[f])
    dll = F.when(both(0), (F.col("l0") - F.col("l1")) / F.col("n")[0])
    crossed = F.array_compact(F.array(*[F.when(both(f) & (F.col("n")[6 - f] > 0), (F.col(f"l{f}") - F.col(f"l{f + 1}")) / F.col("n")[6 - f]) for f in (2, 4)]))
    cross = F.when(both(0) & (F.size(crossed) > 0), F.aggregate(crossed, F.lit(0.0), lambda t, v: t + v) / F.size(crossed))
    return state.join(scored, "k").select(F.col("k").alias(by), F.col("n")[0].alias("n"), F.when(both(0), F.col("b")[0][2]).alias("beta"), dll.alias("dll"), (dll - 1 / (2 * F.col("n")[0])).alias("dll_adj"), cross.alias("dll_cross"))


def split_half(panel: DataFrame) -> DataFrame:
    """round, n, rho: the rank correlation over forecasters of the mean Brier on two halves of the questions (by their hash)."""
    side = F.pmod(F.xxhash64("question"), F.lit(2))
    b = F.pow(F.col("p") - F.col("y"), 2)
    g = panel.groupBy("round", "forecaster").agg(F.avg(F.when(side == 0, b)).alias("a"), F.avg(F.when(side == 1, b)).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    from pyspark.sql import Window

    def mean_rank(c: str) -> Column:
        w = Window.partitionBy("round").orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy("round", c)) - 1) / 2

    r = g.withColumn("ra", mean_rank("a")).withColumn("rb", mean_rank("b"))
    return r.groupBy("round").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
