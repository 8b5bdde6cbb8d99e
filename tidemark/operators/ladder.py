"""Persistence rungs of series ("does it hold its level h steps on?"): candidates, projections, prices learned on what had
resolved, and quantities by Monte Carlo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_even, mean_of, normal_cdf, normal_quantile, settled
from .series import gather

#: First origin, steps ahead, steps between origins, least volatility, resolved rungs a fit needs.
TRAIL, AHEAD, EVERY, FLOOR, MIN_TRAIN = 6, 2, 1, 0.02, 150
#: Financial terms that a card's question must not ask of a ticker.
FINANCIAL = "revenue|revenues|EPS|earnings per share|net income|gross margin|share price|stock price|market cap"
FEATURES = ("drift", "vol", "last", "accel", "drawdown")


def eligible(points: DataFrame, health: DataFrame, trail: int = TRAIL, ahead: int = AHEAD) -> DataFrame:
    """Points of the series that have enough of them and whose audit did not fail."""
    n = points.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") >= trail + ahead + 2).select("series_id")
    return points.join(n, "series_id", "left_semi").join(health.filter("status = 'fail'").select("series_id"), "series_id", "left_anti")


def candidates(points: DataFrame, trail: int = TRAIL, ahead: int = AHEAD, every: int = EVERY) -> DataFrame:
    """series_id, i (index of the origin), origin, resolves, threshold, the five features of the history up to the origin, mu, sigma,
    n_rets, y (did the value hold). Origins run from `trail` to the last that has `ahead` later points.

    What the history says is a running aggregate over the series in order: each point is looked at a bounded number of times."""
    own = Window.partitionBy("series_id").orderBy("x")
    sofar = own.rowsBetween(Window.unboundedPreceding, 0)
    p = points.select("series_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    before = F.lag("y").over(own)
    p = p.withColumn("r", F.when((F.col("y") > 0) & (before > 0), F.log(F.col("y") / before))).withColumn("i", F.row_number().over(own) - 1)
    p = p.withColumn("resolves", F.lead("x", ahead).over(own)).withColumn("later", F.lead("y", ahead).over(own)).withColumn("peak", F.max("y").over(sofar))
    p = p.withColumn("mu", F.avg("r").over(sofar)).withColumn("sd", F.stddev_samp("r").over(sofar)).withColumn("m", F.count("r").over(sofar).cast("int"))
    # The mean of the newest three returns there are, carried on over steps that have none.
    three = F.avg("r").over(Window.partitionBy("series_id", F.col("r").isNotNull()).orderBy("x").rowsBetween(-2, 0))
    p = p.withColumn("three", F.when(F.col("r").isNotNull(), three))
    p = p.withColumn("recent", F.last("three", ignorenulls=True).over(sofar)).withColumn("newest", F.last("r", ignorenulls=True).over(sofar))
    p = p.filter((F.col("i") >= trail) & ((F.col("i") - trail) % every == 0) & F.col("resolves").isNotNull() & (F.col("y") > 0) & (F.col("m") >= 3))
    return p.select(
        "series_id", "i", F.col("x").alias("origin"), "resolves", F.col("y").alias("threshold"), F.col("mu").alias("drift"), F.greatest(F.lit(1e-6), "sd").alias("vol"), F.col("newest").alias("last"),
        (F.col("recent") - F.col("mu")).alias("accel"), F.when(F.col("peak") > 0, (F.col("y") - F.col("peak")) / F.col("peak")).otherwise(0.0).alias("drawdown"), "mu", F.greatest(F.lit(FLOOR), "sd").alias("sigma"), F.col("m").alias("n_rets"),
        F.when(F.col("later") >= F.col("y"), 1.0).otherwise(0.0).alias("y"),
    )


def hold_p(mu: Column, sigma: Column, h: Column) -> Column:
    """P(the level is held) after h log-normal steps with known drift and volatility: the closed form of the projection."""
    return normal_cdf(mu * F.sqrt(h) / sigma)


def project(rungs: DataFrame, ahead: int = AHEAD, draws: int = 20_000, seed: int = 11, honest: bool = True) -> DataFrame:
    """rungs with p_hold, median, low, high (10th and 90th percentile, element int(q n)) of the level `ahead` steps on. Honest
    tails draw volatility and drift from their posterior given n_rets returns. Random numbers belong to the rung."""

    def run(pdfs):
        for pdf in pdfs:
            out = np.zeros((len(pdf), 4))
            for k, r in enumerate(pdf.itertuples(index=False)):
                word = pd.util.hash_array(np.array([f"{r.series_id}\x1f{r.i}"], dtype=object))[0]
                rng = np.random.default_rng([seed, int(word >> np.uint64(32)), int(word & np.uint64(0xFFFFFFFF))])
                sd, mu = np.full(draws, r.sigma), np.full(draws, r.mu)
                if honest:
                    df = max(1, r.n_rets - 1)
                    sd = r.sigma * np.sqrt(df / rng.chisquare(df, draws))
                    mu = r.mu + rng.standard_normal(draws) * sd / np.sqrt(r.n_rets)
                v = np.sort(r.threshold * np.exp(mu * ahead + rng.standard_normal(draws) * sd * np.sqrt(ahead)))
                out[k] = [(v >= r.threshold).mean(), v[draws // 2], v[draws // 10], v[9 * draws // 10]]
            yield pdf.assign(p_hold=out[:, 0], median=out[:, 1], low=out[:, 2], high=out[:, 3])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rungs.schema) + ", p_hold double, median double, low double, high double"
    return rungs.mapInPandas(run, kinds)


def fit_logistic(x: np.ndarray, y: np.ndarray, iters: int = 2500, rate: float = 0.3, l2: float = 1e-3):
    """Weights of the standardised features, bias, means and deviations, by batch gradient descent from zero."""
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-9)
    z, w, b = (x - mean) / dev, np.zeros(x.shape[1]), 0.0
    for _ in range(iters):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * (z.T @ e / len(y) + l2 * w), b - rate * e.mean()
    return w, b, mean, dev


def expanding_base_rate(rungs: DataFrame) -> DataFrame:
    """origin, n_known, base: the outcomes of the rungs that had resolved by each origin (one half if none had). Counts are added
    per step first; only steps are ordered."""
    per = rungs.groupBy(F.col("resolves").alias("at")).agg(F.count("*").alias("n"), F.sum("y").alias("yes"), F.lit(False).alias("asked"))
    steps = per.unionByName(rungs.select(F.col("origin").alias("at")).distinct().select("at", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("yes"), F.lit(True).alias("asked")))
    upto = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)  # a row or two for each step
    g = steps.withColumn("n_known", F.sum("n").over(upto)).withColumn("all", F.sum("yes").over(upto)).filter("asked")
    return g.select(F.col("at").alias("origin"), "n_known", F.when(F.col("n_known") > 0, F.col("all") / F.col("n_known")).otherwise(0.5).alias("base"))


def price(rungs: DataFrame, min_train: int = MIN_TRAIN, sample: int = 200_000) -> DataFrame:
    """rungs with price: per origin, a logistic model of the features fitted on the rungs that had resolved by then; under
    `min_train` of them, their base rate. An origin is a task; it fits on `sample` rungs at most, those of least id hashes (a
    documented bound on the fit alone), and the rungs of the origin are priced by a join with the fitted weights.

    A rung teaches all origins from its resolution on, but with a chance that leaves about `sample` for each, and that chance falls with
    the origins: so it goes to neighbouring ones, from the first after its resolution to the last that may still take it, and meets
    them by their numbers."""
    base = expanding_base_rate(rungs)
    order = Window.orderBy("origin")  # a row for each step, here and below
    due = base.filter(F.col("n_known") >= min_train).select("origin", "n_known", F.row_number().over(order).alias("nth"))
    steps = rungs.select(F.col("resolves").alias("at")).distinct().withColumn("nth", F.lit(None).cast("int")).unionByName(due.select(F.col("origin").alias("at"), "nth"))
    first = steps.withColumn("first", F.min("nth").over(Window.orderBy("at").rangeBetween(0, Window.unboundedFollowing))).filter("nth IS NULL").select(F.col("at").alias("resolves"), "first")
    # The last origin that takes rungs of a chance of 2^-(level + 1) or more: one row for each level.
    chance = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n_known"))
    last = due.select(F.explode(F.sequence(F.lit(0), F.lit(53))).alias("level"), "nth", chance.alias("chance")).filter(F.col("chance") >= F.pow(F.lit(2.0), -(F.col("level") + 1.0))).groupBy("level").agg(F.max("nth").alias("final"))
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    known = rungs.select("resolves", "y", F.array(*FEATURES).alias("f"), F.xxhash64("series_id", "i").alias("h")).withColumn("place", place)
    level = F.least(F.lit(53), F.floor(-F.log2(F.greatest("place", F.lit(2.0**-53)))).cast("int"))
    near = known.withColumn("level", level).join(F.broadcast(first), "resolves").join(F.broadcast(last), "level").filter("first <= final")
    met = near.withColumn("nth", F.explode(F.sequence("first", "final"))).join(F.broadcast(due), "nth")
    train = met.filter(F.col("place") * F.col("n_known") <= sample).select("origin", "f", "y", "h")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        w, b, mean, dev = fit_logistic(np.stack(pdf["f"].to_numpy()), pdf["y"].to_numpy())
        return pd.DataFrame({"origin": [pdf["origin"].iloc[0]], "w": [(w / dev).tolist()], "b": [float(b - (w * mean / dev).sum())]})

    models = train.groupBy("origin").applyInPandas(run, "origin double, w array<double>, b double")
    df = rungs.join(base, "origin").join(models, "origin", "left")
    z = F.aggregate(F.zip_with(F.array(*FEATURES), "w", lambda x, w: x * w), F.col("b"), lambda t, v: t + v)
    return df.withColumn("price", F.when(F.col("w").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(F.col("base"))).drop("w", "b", "base", "n_known")


def resolved(rungs: DataFrame, points: DataFrame, span: float) -> DataFrame:
    """rungs with due, seen_x, outcome: what the series showed `span` steps of time after the origin, which is another thing than the label
    a given number of observations on. The value is that of the last point up to the due time (seen_x its own time); a rung whose
    series ends before that is open (nulls).

    As-of join: points and due times of a series are one ordered sequence, and a due time takes the last value before it."""
    due = rungs.select("series_id", "i", (F.col("origin") + span).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"))
    have = points.select("series_id", F.lit(None).cast("int").alias("i"), F.col("x").cast("double").alias("t"), F.lit(0).alias("kind"), F.col("y").cast("double").alias("v"))
    own = Window.partitionBy("series_id").orderBy("t", "kind")
    carried = F.last(F.when(F.col("kind") == 0, F.struct("t", "v")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    every = have.unionByName(due).withColumn("seen", carried).withColumn("end", F.max(F.when(F.col("kind") == 0, F.col("t"))).over(Window.partitionBy("series_id")))
    at = every.filter("kind = 1").select("series_id", "i", F.col("t").alias("due"), F.when(F.col("end") >= F.col("t"), F.col("seen")).alias("seen"))
    df = rungs.join(at, ["series_id", "i"])
    return df.withColumn("seen_x", F.col("seen.t")).withColumn("outcome", F.when(F.col("seen").isNotNull(), (F.col("seen.v") >= F.col("threshold")).cast("int"))).drop("seen")


def issued(priced: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """Priced rungs with low, median, high: the 10th, 50th and 90th percentile of the log-normal projection, all moved by what gives the
    threshold the price as its probability, so that price and interval are one posterior."""
    wide = F.col("sigma") * F.sqrt(F.lit(float(ahead)))
    at = lambda z: F.col("threshold") * F.exp(F.col("mu") * ahead + z * wide)
    df = priced.withColumn("shift", F.col("threshold") - at(normal_quantile(1 - F.col("price"))))
    return df.withColumns({n: at(F.lit(z)) + F.col("shift") for n, z in (("low", -1.2815515655446004), ("median", 0.0), ("high", 1.2815515655446004))})


# Quantities of cards: samples are arrays, ascending.
def quantile_grid(samples: Column, n: int = 1001) -> Column:
    """n order statistics that stand for the sample."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(samples, (half_even(k / F.lit(n - 1.0) * (F.size(samples) - 1)) + 1).cast("int")))


def grid_quantile(grid: Column, p: Column) -> Column:
    return F.element_at(grid, (half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * (F.size(grid) - 1)) + 1).cast("int"))


def tilt(grid: Column, p: Column, threshold: Column, rising: Column) -> Column:
    """The shift of a grid after which the threshold is met with probability p."""
    return threshold - F.when(rising, grid_quantile(grid, 1 - p)).otherwise(grid_quantile(grid, p))


def beyond_p(samples: Column, threshold: Column, rising: Column) -> Column:
    """Share of the samples at or beyond the threshold."""
    hit = F.filter(samples, lambda v: F.when(rising, v >= threshold).otherwise(v <= threshold))
    return F.size(hit) / F.size(samples)


def grow(cards: DataFrame, draws: int = 20_000, seed: int = 3) -> DataFrame:
    """cards (card_id, level, growth, growth_sd, slowing, years, threshold, rising) with median, low, high, p: each year the level
    grows by a draw around growth less slowing per year (a year's factor is 0.85 at least), and a count is drawn at the end."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, *np.frombuffer(pd.util.hash_array(np.array([str(r.card_id)], dtype=object)).tobytes(), np.uint32).tolist()])
                v = np.full(draws, float(r.level))
                for h in range(int(r.years)):
                    v *= np.maximum(r.growth - r.slowing * h + rng.standard_normal(draws) * r.growth_sd, 0.85)
                v = np.sort(np.maximum(0.0, v + rng.standard_normal(draws) * np.sqrt(np.maximum(v, 0.0))))
                rows.append((r.card_id, v[draws // 2], v[draws // 10], v[9 * draws // 10], float((v >= r.threshold).mean() if r.rising else (v <= r.threshold).mean())))
            yield pd.DataFrame(rows, columns=["card_id", "median", "low", "high", "p"])

    return cards.mapInPandas(run, f"card_id {cards.schema['card_id'].dataType.simpleString()}, median double, low double, high double, p double")


def refused_cards(cards: DataFrame, health: DataFrame) -> DataFrame:
    """Cards that must not be issued, with the reason: a question about one company's figures (a ticker in brackets and a financial term
    together), a seed series whose audit failed, probability and interval that contradict each other."""
    trade = F.col("question").rlike(r"\([A-Z]{2,5}\)") & F.col("question").rlike(rf"(?i)\b({FINANCIAL})\b")
    failed = health.filter("status = 'fail'").select(F.col("series_id").alias("seed"), F.lit(True).alias("bad"))
    df = cards.join(failed, "seed", "left")
    edge = F.lit(1e-9) + F.lit(0.02) * (F.col("high") - F.col("low"))
    below, above = F.col("threshold") < F.col("low") - edge, F.col("threshold") > F.col("high") + edge
    sure = F.when(F.col("rising"), below).otherwise(above)
    never = F.when(F.col("rising"), above).otherwise(below)
    clash = (F.col("high") < F.col("low")) | (sure & (F.col("p") < 0.90 - 0.05)) | (never & (F.col("p") > 0.10 + 0.05))
    why = F.when(trade, "instrument").when(F.col("bad"), "seed failed its audit").when(clash, "probability against interval")
    return df.withColumn("why", why).filter("why IS NOT NULL").select("card_id", "why")


def crossing_p(points: DataFrame, by: Column, threshold: Column, falling: Column, window: int = 12) -> DataFrame:
    """series_id, p, median, low, high: the value at step `by` if the last `window` differences repeat independently (normal with
    their mean and deviation): the closed form of the simulation."""
    g = gather(points, ["series_id"]).withColumn("recent", F.slice("pts", F.greatest(F.lit(1), F.size("pts") - window + 1), F.lit(window)))
    diffs = F.transform(F.slice("recent", F.lit(1), F.size("recent") - 1), lambda p, k: F.element_at("recent", k + 2)["y"] - p["y"])
    g = g.filter(F.size("pts") >= 3).withColumn("diffs", diffs).withColumn("mu", mean_of(F.col("diffs"))).withColumn("now", F.element_at("pts", -1)["y"]).withColumn("h", by - F.element_at("pts", -1)["x"]).filter("h > 0")
    sd = F.sqrt(F.aggregate("diffs", F.lit(0.0), lambda a, v: a + (v - F.col("mu")) * (v - F.col("mu"))) / F.size("diffs"))
    g = g.withColumn("mid", F.col("now") + F.col("h") * F.col("mu")).withColumn("wide", F.greatest(F.lit(1e-9), sd * F.sqrt("h"))).withColumn("level", threshold)
    z = (F.col("level") - F.col("mid")) / F.col("wide")
    return settled(g, ["series_id"], p=F.when(falling, normal_cdf(z)).otherwise(1 - normal_cdf(z)), median=F.col("mid"), low=F.col("mid") - 1.2815515655446004 * F.col("wide"), high=F.col("mid") + 1.2815515655446004 * F.col("wide"))
