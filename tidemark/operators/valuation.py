"""Valuation gaps, pair payoffs and how widely a topic is covered already."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kelly fraction and cap of a position; concentration of the thesis' probability; slippage of the hedge; ratio and
#: deviation where the thesis fails.
KELLY, CAP, KAPPA, SLIPPAGE, MISS, MISS_SD = 0.25, 0.03, 14.0, 0.12, 0.85, 0.20
#: Weights of outlets and recency, outlets that saturate, where a topic is priced, years that are recent.
OUTLETS, RECENT, ENOUGH, PRICED, YEARS = 0.80, 0.20, 5, 0.55, 2


def layers(quotes: DataFrame, filings: DataFrame) -> DataFrame:
    """symbol, market_cap, ps: the last price times shares, and that over revenue (null without)."""
    last = quotes.groupBy("symbol").agg(F.max_by("close", "d").alias("price"), F.max("d").alias("priced_on"))
    cap = F.col("price") * F.col("shares")
    return last.join(filings, "symbol").select("symbol", "priced_on", cap.alias("market_cap"), F.when(F.col("revenue") > 0, cap / F.col("revenue")).alias("ps"))


def verdict(median: Column, low: Column, high: Column, bar: Column, confident: Column) -> Column:
    edge = F.when(confident, "edge").otherwise("edge_low_conf")
    return F.when((median > bar) & (low > 0), edge).when(high < 0, "priced_in").otherwise("inconclusive")


def language_leg(base: Column, n1: Column, all1: Column, n2: Column, all2: Column) -> Column:
    """The deviation of the expectations proxy: 0.6 of it if the inelastic layer speaks of constraints at least 20 points more often
    than the elastic one; unchanged if either is unknown."""
    d1, d2 = F.least(n1, all1) / all1, F.least(n2, all2) / all2
    return F.when(d1 >= d2 + 0.20, F.bround(base * 0.6, 3)).otherwise(base)


def short_leg(base: Column, ratio1: Column, ratio2: Column) -> Column:
    """Wider by a quarter if the inelastic layer is shorted five points more, tighter by a fifth if five points less."""
    gap = ratio1 - ratio2
    return F.when(gap >= 0.05, F.bround(base * 1.25, 3)).when(gap <= -0.05, F.bround(base * 0.80, 3)).otherwise(base)


def short_ratio(volumes: DataFrame, days: int = 5, back: int = 21) -> DataFrame:
    """symbol, ratio: the mean of short over total volume of the last `days` days within `back` days of the symbol's last one."""
    v = volumes.filter("total > 0")
    last = v.groupBy("symbol").agg(F.max("d").alias("last"))
    recent = v.join(last, "symbol").filter(F.datediff("last", "d") <= back)
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))  # `back` rows at most
    return recent.withColumn("nth", nth).filter(F.col("nth") <= days).groupBy("symbol").agg(F.avg(F.col("short") / F.col("total")).alias("ratio"))


def run_up(quotes: DataFrame, at: Column, least: int = 30) -> DataFrame:
    """symbol, r1, r3, hot: the last price up to `at` against the last one a year and three years earlier; hot from 1.5 and 2. Null
    under `least` quotes."""
    q = quotes.filter(F.col("d") <= at)
    upto = lambda years: F.max_by(F.when(F.col("d") <= F.add_months(at, -12 * years), F.col("close")), F.when(F.col("d") <= F.add_months(at, -12 * years), F.col("d")))
    g = q.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "d").alias("now"), upto(1).alias("y1"), upto(3).alias("y3"))
    r = lambda y: F.when((F.col("n") >= least) & (F.col(y) > 0), F.col("now") / F.col(y))
    g = g.select("symbol", "n", r("y1").alias("r1"), r("y3").alias("r3"))
    return g.select("symbol", "r1", "r3", F.when(F.col("n") >= least, F.coalesce(F.col("r3") >= 2, F.lit(False)) | F.coalesce(F.col("r1") >= 1.5, F.lit(False))).alias("hot"))


def _rng(seed: int, key) -> np.random.Generator:
    return np.random.default_rng([seed, *np.frombuffer(pd.util.hash_array(np.array([str(key)], dtype=object)).tobytes(), np.uint32).tolist()])


def valuation_delta(pairs: DataFrame, draws: int = 200_000, seed: int = 7) -> DataFrame:
    """pairs (pair, ps1, ps2, fair, fair_sd, proxy_sd, bar) -> pair, median, low, high, p_positive, p_over of fair ratio less market
    ratio: price, shares and revenue of both layers vary by 4, 2 and 5 %, the fair ratio and the proxy are log-normal."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                rng = _rng(seed, r.pair)
                vary = lambda sd: 1 + sd * rng.standard_normal(draws)
                ps = lambda x: x * vary(0.04) * vary(0.02) / np.maximum(vary(0.05), 1e-9)
                market = ps(r.ps1) / ps(r.ps2) * np.exp(r.proxy_sd * rng.standard_normal(draws))
                d = np.sort(r.fair * np.exp(r.fair_sd * rng.standard_normal(draws)) - market)
                rows.append((r.pair, d[draws // 2], d[draws // 10], d[9 * draws // 10], float((d > 0).mean()), float((d > r.bar).mean())))
            yield pd.DataFrame(rows, columns=["pair", "median", "low", "high", "p_positive", "p_over"])

    return pairs.mapInPandas(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, median double, low double, high double, p_positive double, p_over double")


def pair_payoff(pairs: DataFrame, draws: int = 200_000, seed: int = 12) -> DataFrame:
    """pairs (pair, market, fair, fair_sd, p_bottleneck) -> pair, median, low, high, p_win, kelly, kelly_low, kelly_high of the pair's
    return: the ratio moves to the fair one if the thesis holds (its probability is Beta around p_bottleneck), else to that of a
    miss; the hedge slips. Kelly is mean over variance."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                rng, m = _rng(seed, r.pair), min(max(r.p_bottleneck, 0.05), 0.95)
                holds = rng.random(draws) < rng.beta(m * KAPPA, (1 - m) * KAPPA, draws)
                target = np.where(holds, r.fair * np.exp(r.fair_sd * rng.standard_normal(draws)), MISS * np.exp(MISS_SD * rng.standard_normal(draws)))
                g = np.sort(target / r.market * (1 + SLIPPAGE * rng.standard_normal(draws)) - 1)
                low, high, var = g[draws // 10], g[9 * draws // 10], g.var()
                k = lambda x: float(x / var) if var > 0 else 0.0
                rows.append((r.pair, g[draws // 2], low, high, float((g > 0).mean()), k(g.mean()), max(k(low), 0.0), max(k(high), 0.0)))
            yield pd.DataFrame(rows, columns=["pair", "median", "low", "high", "p_win", "kelly", "kelly_low", "kelly_high"])

    return pairs.mapInPandas(run, f"pair {pairs.schema['pair'].dataType.simpleString()}, median double, low double, high double, p_win double, kelly double, kelly_low double, kelly_high double")


def size(kelly: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(KELLY) * kelly, F.lit(CAP)))


def bets(consensus: DataFrame, payoffs: DataFrame) -> DataFrame:
    """pair, size of the pairs whose verdict is a confident edge; no other is translated."""
    return consensus.filter("verdict = 'edge'").join(payoffs, "pair").select("pair", size(F.col("kelly")).alias("size"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#]+)", 1), r"^www\.", "")


def saturation(hits: DataFrame, authority: Column, year: Column, dated: Column | None = None) -> DataFrame:
    """hits (topic, url, text) -> topic, n_hits, n_outlets, n_recent, saturation, tier, verdict. Equal urls count once; outlets are
    distinct hosts of authority; a hit is recent if it names a year from two before `year` on, in its url or text unless `dated` says
    where (urls that end in numbers seem to name years). No hits: no row (unmeasured)."""
    h = hits.filter("url IS NOT NULL AND url <> ''").dropDuplicates(["topic", "url"])
    years = F.transform(F.regexp_extract_all(F.concat_ws(" ", "url", "text") if dated is None else dated, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    g = h.groupBy("topic").agg(F.count("*").alias("n_hits"), F.count_distinct(F.when(authority, host(F.col("url")))).alias("n_outlets"), F.count_if(F.array_max(years) >= year - YEARS).alias("n_recent"))
    s = F.bround(F.lit(OUTLETS) * F.least(F.lit(1.0), F.col("n_outlets") / ENOUGH) + F.lit(RECENT) * F.col("n_recent") / F.col("n_hits"), 3)
    g = g.withColumn("saturation", s)
    tier = F.when(F.col("saturation") >= 0.65, "saturated").when(F.col("saturation") >= 0.50, "mainstream").when(F.col("saturation") >= 0.30, "emerging").otherwise("obscure")
    return g.withColumn("tier", tier).withColumn("verdict", F.when(F.col("saturation") >= PRICED, "priced/known").otherwise("pre_consensus"))


def consensus_forecast(hits: DataFrame, forecaster: Column, authority: Column) -> DataFrame:
    """topic, n_forecasters, n_covered, verdict: two forecasting outlets price a claim, one does partly, three outlets of authority
    cover it; less confirms nothing."""
    h = hits.filter("url IS NOT NULL AND url <> ''").dropDuplicates(["topic", "url"])
    of = lambda c: F.count_distinct(F.when(c, host(F.col("url"))))
    g = h.groupBy("topic").agg(of(forecaster).alias("n_forecasters"), of(authority).alias("n_covered"))
    v = F.when(F.col("n_forecasters") >= 2, "priced").when(F.col("n_forecasters") == 1, "partly").when(F.col("n_covered") >= 3, "covered").otherwise("unconfirmed")
    return g.withColumn("verdict", v)


def latest_for(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key, as a struct maximum: no window, added map-side."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
