"""Point-in-time back-tests: cohorts, share gains, rolling origins. Every function filters to what was known before it looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import settled

WINDOW, CAP = 3, 1e6


def cohort_totals(points: DataFrame, cohort: list[str]) -> DataFrame:
    """cohort, x, total, members (most series in any x of the cohort)."""
    yearly = points.groupBy(*cohort, "x").agg(F.sum("y").alias("total"), F.countDistinct("series_id").alias("m"))
    most = yearly.groupBy(*cohort).agg(F.max("m").alias("members"))
    return yearly.drop("m").join(most, cohort)


def shares(points: DataFrame, cohort: list[str]) -> DataFrame:
    """points with share of their cohort's total of the year (null where the total is 0) and members."""
    return points.join(cohort_totals(points, cohort), [*cohort, "x"]).withColumn("share", F.when(F.col("total") != 0, F.col("y") / F.col("total")))


def gain_share(shared: DataFrame, key: list[str], origins: list[int], margin: float = 1.5, min_known: int = 8, min_future: int = 3, min_cohort: int = 5) -> DataFrame:
    """key, origin, n_known, n_future, multiple, winner, lead: the mean share of the last 3 known periods (those after origin - 3)
    against that of the last 3 future periods there are; zero shares don't count; null where a side is empty. lead: periods to the
    first future one whose share reaches margin times the known mean.

    All origins are answered from one gathered array per series: origins multiply expressions, not the shuffle."""
    g = shared.filter(F.col("members") >= min_cohort).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("x", "share"))).alias("s"))
    g = g.withColumn("origin", F.explode(F.array(*[F.lit(o) for o in origins])))
    o = F.col("origin")
    g = g.withColumn("known", F.filter("s", lambda p: p["x"] <= o)).withColumn("future", F.filter("s", lambda p: p["x"] > o)).withColumn("n_known", F.size("known")).withColumn("n_future", F.size("future"))
    g = g.filter((F.col("n_known") >= min_known) & (F.col("n_future") >= min_future))
    solid = lambda a: F.filter(F.transform(a, lambda p: p["share"]), lambda v: v.isNotNull() & (v != 0))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / F.size(a))
    last = F.slice("future", -F.least(F.lit(WINDOW), F.size("future")), F.lit(WINDOW))
    g = g.withColumn("before", mean(solid(F.filter("known", lambda p: p["x"] > o - WINDOW)))).withColumn("after", mean(solid(last)))
    g = g.withColumn("multiple", F.least(F.col("after") / F.col("before"), F.lit(CAP))).withColumn("winner", F.col("multiple") >= margin)
    reach = F.filter("future", lambda p: (p["share"] != 0) & (p["share"] / F.col("before") >= margin))
    lead = F.when(F.size(reach) > 0, F.array_min(F.transform(reach, lambda p: p["x"])) - o)
    return settled(g, [*key, "origin"], n_known=F.col("n_known"), n_future=F.col("n_future"), multiple=F.col("multiple"), winner=F.col("winner"), lead=lead)


def measurable(points: DataFrame, key: list[str], upto: Column, k: float = 3.0) -> DataFrame:
    """key, snr, measurable: is the median square root of the known counts at least k?"""
    return points.filter(F.col("x") <= upto).groupBy(*key).agg(F.median(F.sqrt(F.greatest(F.col("y"), F.lit(0.0)))).alias("snr")).withColumn("measurable", F.col("snr") >= k)


def leave_one_origin_out(events: DataFrame, origin: str = "origin") -> DataFrame:
    """brier_model, brier_base, n: P(win | fired) and P(win | silent) learned on the other origins only. Totals less the own
    origin's counts: no loop over origins."""
    f, w = F.col("fired"), F.col("winner")
    own = events.filter(f.isNotNull() & w.isNotNull()).groupBy(origin).agg(F.count_if(f & w).alias("a"), F.count_if(f & ~w).alias("b"), F.count_if(~f & w).alias("c"), F.count_if(~f & ~w).alias("d"))
    total = own.agg(*(F.sum(x).alias(f"t{x}") for x in "abcd"), F.count("*").alias("origins"))
    j = own.crossJoin(F.broadcast(total))  # total: one row
    a, b, c, d = (F.col(f"t{x}") - F.col(x) for x in "abcd")
    base = (a + c) / (a + b + c + d)
    j = j.filter((F.col("origins") >= 2) & (a + b + c + d > 0)).select(*"abcd", base.alias("base"), F.when(a + b > 0, a / (a + b)).otherwise(base).alias("pf"), F.when(c + d > 0, c / (c + d)).otherwise(base).alias("ps"))
    sq = lambda p, y: F.pow(F.col(p) - y, 2)
    model = F.sum(F.col("a") * sq("pf", 1.0) + F.col("b") * sq("pf", 0.0) + F.col("c") * sq("ps", 1.0) + F.col("d") * sq("ps", 0.0))
    naive = F.sum((F.col("a") + F.col("c")) * sq("base", 1.0) + (F.col("b") + F.col("d")) * sq("base", 0.0))
    n = F.sum(F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    return j.agg((model / n).alias("brier_model"), (naive / n).alias("brier_base"), n.alias("n"))


def earliest(events: DataFrame, key: str = "series_id", origin: str = "origin") -> DataFrame:
    """One scored event for each concept: that of its earliest scored origin."""
    scored = events.filter("fired IS NOT NULL AND winner IS NOT NULL")
    return scored.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), origin).alias("e")).select(key, "e.*")


def grid(ks=(2.5, 3.0, 3.5), margins=(1.3, 1.5, 2.0), channels=("count", "diffusion", "talent")) -> list[tuple]:
    """The registered configurations. Surprise and multiple depend on none of them, so a run evaluates all on one frame."""
    return [(k, m, c) for k in ks for m in margins for c in channels]


def refuse_sealed(origins, sealed=(2018, 2020)) -> None:
    """Raises before any plan is made if a sealed origin is asked for."""
    if bad := sorted(set(origins) & set(sealed)):
        raise ValueError(f"sealed test origins: {bad}")


def split_of(name: Column, salt: str) -> Column:
    """'test' for one third of the concepts by their hash, else 'train' or 'validation'."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), name)), 1, 8), 16, 10).cast("long") % 3
    return F.when(bucket == 2, "test").when(bucket == 1, "validation").otherwise("train")
