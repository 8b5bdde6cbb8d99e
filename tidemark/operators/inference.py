"""Look-elsewhere inference: false-discovery control, exact tests, block permutation, bootstrap, power."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import CAP, HOLDOUT, LOG_FLOOR, MIN_POINTS, gather


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: float = 0.10, family: list[str] = ()) -> DataFrame:
    """Adds rank (tests of the family whose p is no greater), n_tests and survive (step-up at rate q). Tests without p have none.

    Equal p are counted first; prefix counts run inside 4096 slices of [0, 1] and over the slices, so no task orders all tests."""
    family = list(family)
    per = tests.filter(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("v")).agg(F.count("*").alias("c")).withColumn("slice", F.floor(F.col("v") * 4096))
    size = per.groupBy(*family, "slice").agg(F.sum("c").alias("size"))
    over = Window.partitionBy(*family).orderBy("slice")  # 4097 rows a family
    below = size.select(*family, "slice", F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("size").over(Window.partitionBy(*family)).alias("n_tests"))
    ranked = per.join(below, [*family, "slice"]).withColumn("rank", F.col("below") + F.sum("c").over(Window.partitionBy(*family, "slice").orderBy("v")))
    last = F.coalesce(F.max(F.when(F.col("v") <= F.col("rank") / F.col("n_tests") * q, F.col("v"))), F.lit(-1.0))
    bar = ranked.groupBy(*family).agg(last.alias("bar")) if family else ranked.agg(last.alias("bar"))
    ranked = ranked.join(bar, family) if family else ranked.crossJoin(F.broadcast(bar))  # one row
    return tests.join(ranked.select(*family, F.col("v").alias(p), "rank", "n_tests", (F.col("v") <= F.col("bar")).alias("survive")), [*family, p])


def deflate(p: Column, configs: Column) -> Column:
    """Bonferroni over every configuration that was allowed."""
    return F.least(F.lit(1.0), p * F.greatest(F.lit(1), configs))


def confusion(events: DataFrame, by: list[str] = (), fired: str = "fired", won: str = "winner") -> DataFrame:
    """2 x 2 counts with precision, base rate, recall, silent rate and lift; events with a null on either side are unscored."""
    f, w = F.col(fired), F.col(won)
    g = events.filter(f.isNotNull() & w.isNotNull()).groupBy(*by).agg(F.count_if(f & w).alias("a"), F.count_if(f & ~w).alias("b"), F.count_if(~f & w).alias("c"), F.count_if(~f & ~w).alias("d"))
    n, a, b, c, d = F.col("a") + F.col("b") + F.col("c") + F.col("d"), *(F.col(x) for x in "abcd")
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    g = g.withColumn("n", n).withColumn("base_rate", div(a + c, F.col("n"))).withColumn("precision", div(a, a + b)).withColumn("recall", div(a, a + c)).withColumn("silent_rate", div(c, c + d))
    return g.withColumn("lift", div(F.col("precision"), F.col("base_rate")))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1 (error under 1e-12): the series of Stirling at x + 8, stepped back."""
    z = x + 8
    series_ = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return series_ - F.log(steps)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided Fisher exact p of a 2 x 2 table by the hypergeometric tail, in logarithms. Each term follows from the one before it
    by a ratio of counts, so a row takes as many steps as the tail has terms and keeps no table."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, row, col = a + b + c + d, a + b, a + c
    lf = lambda x: log_gamma(x + 1)
    first = F.exp(lf(row) - lf(a) - lf(b) + lf(n - row) - lf(c) - lf(d) - lf(n) + lf(col) + lf(n - col))
    top = F.least(row, col).cast("int")
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, x: Column) -> Column:  # from x to x + 1 hits
        term = s["term"] * (row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    xs = F.when(top > a, F.sequence(a.cast("int"), top - 1)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(F.transform(xs, lambda x: x.cast("double")), start, step, lambda s: s["total"])
    return F.when((row == 0) | (row == n) | (col == 0) | (col == n), 1.0).otherwise(F.least(F.lit(1.0), tail))


def _rng(seed: int, *key) -> np.random.Generator:
    """A generator of its own for each key, so results depend neither on order nor on partitioning."""
    words = np.frombuffer(pd.util.hash_array(np.array(["\x1f".join(map(str, key))], dtype=object)).tobytes(), np.uint32)
    return np.random.default_rng([seed, *words.tolist()])


def _theil_sen_many(x: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust lines of many series over the same x (rows of ys)."""
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    i, j = i[ok], j[ok]
    slope = np.zeros(len(ys))
    if len(i):
        for k in range(0, len(ys), 256):  # bounds the pairs held at once
            slope[k : k + 256] = np.median((ys[k : k + 256][:, j] - ys[k : k + 256][:, i]) / (x[j] - x[i]), axis=1)
    return slope, np.median(ys - slope[:, None] * x, axis=1)


def surprise_many(x: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The detector's surprise of many series over the same x, vectorised."""
    n = len(x)
    holdout = max(2, int(np.round(HOLDOUT * n)))
    split = n - holdout
    slope, intercept = _theil_sen_many(x[:split], ys[:, :split])
    e = ys - (slope[:, None] * x + intercept[:, None])
    train = e[:, :split]
    sigma = 1.4826 * np.median(np.abs(train - np.median(train, axis=1, keepdims=True)), axis=1)
    early = ys[:, :split]
    floor = np.maximum(np.maximum(train.std(axis=1), 0.05 * np.maximum(early.max(1) - early.min(1), np.abs(np.median(early, axis=1)))), 1e-9)
    return np.minimum((e[:, split:] / np.where(sigma > 0, sigma, floor)[:, None]).max(axis=1), CAP)


def empirical_p(points: DataFrame, key: list[str], draws: int = 2000, seed: int = 20240, log: bool = False) -> DataFrame:
    """key, surprise, p_mc: how often noise on the series' own early trend surprises as much, (1 + hits) / (draws + 1).

    Surrogates are the early trend plus normal noise of the early MAD scale (its deviation where that is 0; null p where both
    are). A task draws the surrogates of the series it holds; the series is the unit of work, gathered by one shuffle."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.array([p["x"] for p in row.pts])
                y = np.array([p["y"] for p in row.pts])
                if log:
                    y = np.log(np.maximum(y, LOG_FLOOR))
                split = len(x) - max(2, int(np.round(HOLDOUT * len(x))))
                obs = float(surprise_many(x, y[None])[0])
                slope, intercept = _theil_sen_many(x[:split], y[None, :split])
                e = y[:split] - (slope[0] * x[:split] + intercept[0])
                sigma = 1.4826 * np.median(np.abs(e - np.median(e))) or e.std()
                names = [getattr(row, k) for k in key]
                if not sigma > 0:
                    out.append((*names, obs, None))
                    continue
                rng, hits = _rng(seed, *names), 0
                for k in range(0, draws, 500):
                    m = min(500, draws - k)
                    hits += int((surprise_many(x, slope[0] * x + intercept[0] + rng.standard_normal((m, len(x))) * sigma) >= obs).sum())
                out.append((*names, obs, (1 + hits) / (draws + 1)))
            yield pd.DataFrame(out, columns=[*key, "surprise", "p_mc"])

    df = gather(points, key).filter((F.size("pts") >= MIN_POINTS) & (F.size("pts") - F.greatest(F.lit(2), F.bround(F.lit(HOLDOUT) * F.size("pts"), 0).cast("int")) >= 4))
    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", surprise double, p_mc double")


def block_counts(events: DataFrame, block: list[str], fired: str = "fired", won: str = "winner") -> DataFrame:
    """Per block (block_0, ...) its 2 x 2 counts a, b, c, d: all that permutation and bootstrap need."""
    f, w = F.col(fired), F.col(won)
    return events.filter(f.isNotNull() & w.isNotNull()).groupBy(*(F.col(c).alias(f"block_{i}") for i, c in enumerate(block))).agg(F.count_if(f & w).alias("a"), F.count_if(f & ~w).alias("b"), F.count_if(~f & w).alias("c"), F.count_if(~f & ~w).alias("d"))


def _lift(a, fired, wins, n):
    base, precision = wins / np.maximum(n, 1), a / np.maximum(fired, 1)
    return np.where((fired > 0) & (wins > 0), precision / np.where(base > 0, base, 1), 0.0)


def block_permutation(blocks: DataFrame, reps: int = 2000, seed: int = 20240) -> DataFrame:
    """lift, p_block, n_blocks. Shuffling the fired flags inside a block makes its hits hypergeometric, so a repetition is one
    draw per block: blocks x repetitions are drawn in the tasks, then summed per repetition."""

    def draw(pdfs):
        for pdf in pdfs:
            hits = np.zeros(reps, np.int64)
            for i, r in enumerate(pdf.itertuples(index=False)):
                rng = _rng(seed, *[getattr(r, c) for c in pdf.columns])
                hits += rng.hypergeometric(r.a + r.c, r.b + r.d, r.a + r.b, reps)
            yield pd.DataFrame({"rep": np.arange(reps), "hits": hits})

    sums = blocks.agg(*(F.sum(x).alias(f"s{x}") for x in "abcd"), F.count("*").alias("n_blocks"))
    drawn = blocks.mapInPandas(draw, "rep int, hits long").groupBy("rep").agg(F.sum("hits").alias("hits")).crossJoin(F.broadcast(sums))  # sums: one row
    n, fired, wins = F.col("sa") + F.col("sb") + F.col("sc") + F.col("sd"), F.col("sa") + F.col("sb"), F.col("sa") + F.col("sc")
    lift = lambda a: F.when((fired > 0) & (wins > 0), (a / fired) / (wins / n)).otherwise(0.0)
    return drawn.groupBy().agg(F.max(lift(F.col("sa"))).alias("lift"), ((F.count_if(lift(F.col("hits")) >= lift(F.col("sa"))) + 1) / (reps + 1)).alias("p_block"), F.max("n_blocks").alias("n_blocks"))


#: Blocks of one group of the bootstrap, about.
GROUP = 256


def resampled(blocks: DataFrame, reps: int = 2000, seed: int = 20241) -> DataFrame:
    """rep, a, b, c, d, times: the counts of `reps` resamples of whole blocks with replacement, each of as many blocks as there are (times).

    A resample is a multinomial draw. It is split over tasks without being drawn in one: blocks belong to groups by the hash of their
    names, and the groups are the leaves of a binary tree. At each node the draws that reached it go left with a binomial draw of the
    left half's share of the node's blocks. These draws belong to the node, so every group finds its own number of draws by walking
    down from the root, and the groups' numbers add up to the blocks in every repetition. Inside a group the draws fall evenly."""
    names = [c for c in blocks.columns if c not in "abcd"]
    keyed = blocks.select(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names]).alias("block"), *"abcd")
    total = keyed.count()
    depth = max(0, (max(1, total) // GROUP).bit_length())
    keyed = keyed.withColumn("group", F.shiftrightunsigned(F.xxhash64("block"), 64 - depth).cast("int") if depth else F.lit(0))
    sizes = np.zeros(1 << depth, np.int64)
    for r in keyed.groupBy("group").count().collect():  # a row for each group
        sizes[r["group"]] = r["count"]
    levels = [sizes]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0][0::2] + levels[0][1::2])

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        group, here = int(key[0]), np.full(reps, total, np.int64)
        for k in range(depth):
            node = group >> (depth - k)
            left = _rng(seed, "node", k, node).binomial(here, levels[k + 1][2 * node] / max(1, levels[k][node]))
            here = here - left if (group >> (depth - k - 1)) & 1 else left
        own = pdf.sort_values("block")
        times = _rng(seed, "leaf", group).multinomial(here, np.full(len(own), 1 / len(own)))
        return pd.DataFrame({"rep": np.arange(reps), **{c: times @ own[c].to_numpy(np.int64) for c in "abcd"}, "times": here})

    drawn = keyed.groupBy("group").applyInPandas(draw, "rep int, a long, b long, c long, d long, times long")
    return drawn.groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("a", "b", "c", "d", "times")))


def block_bootstrap(blocks: DataFrame, reps: int = 2000, seed: int = 20241, alpha: float = 0.10) -> DataFrame:
    """lift_lo, lift_hi: the percentiles of the lift over resamples of whole blocks."""
    from ..functions.stats import pct_nearest

    fired, wins, n = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    lifts = resampled(blocks, reps, seed).select(F.when((fired > 0) & (wins > 0), (F.col("a") / fired) / (wins / n)).otherwise(0.0).alias("l"))
    return lifts.agg(F.sort_array(F.collect_list("l")).alias("ls")).select(pct_nearest(F.col("ls"), alpha / 2).alias("lift_lo"), pct_nearest(F.col("ls"), 1 - alpha / 2).alias("lift_hi"))


def power_curve(blocks: DataFrame, lifts=(1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), outer: int = 400, inner: int = 2000, level: float = 0.05, seed: int = 20242) -> DataFrame:
    """lift, power, capped: how often the block permutation finds a true lift at the level. Winners fire more, losers less, at the
    observed number of fires; capped where the fire rate cannot express the lift.

    A (lift, outer) pair is a group of the blocks' counts; it draws and tests in its task, so neither the blocks nor the draws meet the
    driver."""
    t = blocks.agg(F.sum(F.col("a") + F.col("b")).alias("fires"), F.sum(F.col("a") + F.col("c")).alias("wins"), F.sum(F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n"))
    names = [c for c in blocks.columns if c not in "abcd"]
    rows = blocks.select(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in names]).alias("block"), "a", "b", "c", "d").crossJoin(F.broadcast(t))  # t: one row
    pairs = rows.withColumn("lift", F.explode(F.array(*[F.lit(float(x)) for x in lifts]))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (lift, k) = pdf.sort_values("block"), key
        fires, wins, n = (int(pdf[c].iloc[0]) for c in ("fires", "wins", "n"))
        rng, w, l = _rng(seed, lift, k), (pdf["a"] + pdf["c"]).to_numpy(), (pdf["b"] + pdf["d"]).to_numpy()
        qw = min(1.0, lift * fires / max(n, 1))
        ql = min(1.0, max(0.0, (fires - wins * qw) / max(n - wins, 1)))
        a, b = rng.binomial(w, qw), rng.binomial(l, ql)
        obs = _lift(a.sum(), (a + b).sum(), wins, n)
        null = sum(rng.hypergeometric(w[i], l[i], a[i] + b[i], inner) for i in range(len(w)))
        p = (1 + int((_lift(null, np.full(inner, (a + b).sum()), wins, n) >= obs).sum())) / (inner + 1)
        return pd.DataFrame({"lift": [lift], "hit": [float(p <= level)], "capped": [bool(lift * fires / max(n, 1) > 1)]})

    return pairs.groupBy("lift", "k").applyInPandas(run, "lift double, hit double, capped boolean").groupBy("lift").agg(F.avg("hit").alias("power"), F.bool_or("capped").alias("capped"))


def detectable(power: DataFrame, target: float = 0.8) -> DataFrame:
    """The least lift of that power, by linear interpolation on the grid (null if the grid never reaches it)."""
    w = Window.orderBy("lift")  # a row for each lift of the grid
    df = power.withColumn("p0", F.lag("power").over(w)).withColumn("l0", F.lag("lift").over(w))
    at = F.when(F.col("p0").isNull() | (F.col("power") == F.col("p0")), F.col("lift")).otherwise(F.col("l0") + (F.lit(target) - F.col("p0")) / (F.col("power") - F.col("p0")) * (F.col("lift") - F.col("l0")))
    return df.filter(F.col("power") >= target).agg(F.min(at).alias("mde"))
