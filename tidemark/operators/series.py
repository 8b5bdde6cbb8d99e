"""Detectors over series of points. A series is gathered once by its key, and every statistic is an expression over its array:
one shuffle, no join; only the middle of a series' slopes is found in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import median_slope_of, longest_run, mad_sigma, mean_of, median_of, pstdev_of, settled, theil_sen_slope

MIN_POINTS, HOLDOUT, LOG_FLOOR, CAP = 8, 0.30, 0.5, 1e6


def gather(points: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row per series with its points ordered by x."""
    return points.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("pts"))


def _residuals(points: Column, slope: Column, intercept: Column) -> Column:
    return F.transform(points, lambda p: p["y"] - (slope * p["x"] + intercept))


def fit(df: DataFrame, points: str, prefix: str = "") -> DataFrame:
    """Adds the robust line of an array of points, however many: slope, intercept."""
    df = df.withColumn(f"{prefix}slope", median_slope_of(F.col(points)))
    return df.withColumn(f"{prefix}intercept", median_of(F.transform(points, lambda p: p["y"] - F.col(f"{prefix}slope") * p["x"])))


def detect(points: DataFrame, key: list[str], k: float = 3.0, log: bool = False) -> DataFrame:
    """Trend and noise from the early 70 % of each series, surprise from the rest.

    Series under 8 points (or under 4 early ones) are left out. The hold-out is round-half-even(0.3 n), 2 at least. sigma is the MAD
    scale, or, where that is 0, the largest of the residuals' deviation, 5 % of the early scale and 1e-9."""
    return judged(gather(points, key), key, k, log)


def detect_at(points: DataFrame, key: list[str], cutoffs: dict, k: float = 3.0, log: bool = False, origin: str = "origin") -> DataFrame:
    """The detector on what was known at several origins (origin -> greatest x): a series is gathered once, and its array is cut at each."""
    at = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(x)).alias("x")) for o, x in cutoffs.items()]))
    df = gather(points, key).withColumn("at", at).withColumn(origin, F.col("at.o")).withColumn("pts", F.filter("pts", lambda p: p["x"] <= F.col("at.x")))
    return judged(df.select(*key, origin, "pts"), [*key, origin], k, log)


def judged(df: DataFrame, key: list[str], k: float = 3.0, log: bool = False) -> DataFrame:
    """The detector on gathered series: key, pts (ordered by x)."""
    df = df.withColumn("n", F.size("pts")).filter(F.col("n") >= MIN_POINTS)
    if log:
        df = df.withColumn("pts", F.transform("pts", lambda p: F.struct(p["x"].alias("x"), F.log(F.greatest(p["y"], F.lit(LOG_FLOOR))).alias("y"))))
    df = df.withColumn("holdout", F.greatest(F.lit(2), F.bround(F.lit(HOLDOUT) * F.col("n"), 0).cast("int"))).withColumn("split", F.col("n") - F.col("holdout")).filter("split >= 4")
    df = fit(df.withColumn("train", F.slice("pts", F.lit(1), F.col("split"))), "train")
    df = df.withColumn("resid", _residuals(F.col("train"), F.col("slope"), F.col("intercept"))).withColumn("mad", mad_sigma(F.col("resid")))
    ys = F.transform("train", lambda p: p["y"])
    scale = F.greatest(F.array_max(ys) - F.array_min(ys), F.abs(median_of(ys)))
    df = df.withColumn("sigma", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.greatest(pstdev_of(F.col("resid")), scale * 0.05, F.lit(1e-9))))
    held = F.slice("pts", F.col("split") + 1, F.col("holdout"))
    df = df.withColumn("surprises", F.transform(_residuals(held, F.col("slope"), F.col("intercept")), lambda r: r / F.col("sigma")))
    need = F.greatest(F.lit(2), F.ceil(F.col("holdout") / 2).cast("int"))
    up, down = longest_run(F.transform("surprises", lambda s: s > 0)), longest_run(F.transform("surprises", lambda s: s < 0))
    df = df.withColumn("surprise", F.least(F.array_max("surprises"), F.lit(CAP))).withColumn("down", F.least(F.greatest(F.lit(0.0), -F.array_min("surprises")), F.lit(CAP))).withColumn("n_up", up).withColumn("n_down", down)
    c = F.col
    return settled(
        df, key, n=c("n"), split=c("split"), slope=c("slope"), intercept=c("intercept"), sigma=c("sigma"), surprise=c("surprise"), fired=c("surprise") >= k,
        sustained_sigma=F.least(mean_of(c("surprises")), F.lit(CAP)), n_consecutive=c("n_up"), sustained=c("n_up") >= need,
        down_surprise=c("down"), n_consecutive_down=c("n_down"), dissolving=(c("down") >= k) & (c("n_down") >= need),
    )


def detect_threshold(points: DataFrame, key: list[str], threshold: Column | None = None, direction: str = "falling", window: int = 12, soon: float = 10.0, horizon: float = 30.0) -> DataFrame:
    """Robust slope of the last `window` points against a level: current, slope, crossed, years_to_cross, status."""
    df = gather(points, key).filter(F.size("pts") >= MIN_POINTS)
    df = df.withColumn("recent", F.slice("pts", F.greatest(F.lit(1), F.size("pts") - window + 1), F.lit(window))).withColumn("slope", theil_sen_slope(F.col("recent"))).withColumn("current", F.element_at("pts", -1)["y"])
    if direction == "peak":
        return settled(df, key, current=F.col("current"), slope=F.col("slope"), crossed=F.col("slope") < 0, years_to_cross=F.lit(None).cast("double"), status=F.when(F.col("slope") < 0, "binding").otherwise("approaching"))
    level = threshold.cast("double")
    df = df.withColumn("level", level)
    falling = direction == "falling"
    crossed = F.col("current") <= F.col("level") if falling else F.col("current") >= F.col("level")
    away = (F.col("current") - F.col("level")) / (-F.col("slope")) if falling else (F.col("level") - F.col("current")) / F.col("slope")
    df = df.withColumn("crossed", crossed).withColumn("years_to_cross", F.when(~F.col("crossed") & ((F.col("slope") < 0) if falling else (F.col("slope") > 0)), away))
    status = F.when(F.col("crossed"), "binding").when(F.col("years_to_cross") <= soon, "crossing_soon").when(F.col("years_to_cross") <= horizon, "approaching").otherwise("stable")
    return settled(df, key, current=F.col("current"), slope=F.col("slope"), crossed=F.col("crossed"), years_to_cross=F.col("years_to_cross"), status=status)


def breakout(points: DataFrame, key: list[str], cutoff: Column, k: float = 3.0, log: bool = False) -> DataFrame:
    """Grades the future (x > cutoff) against the robust line of all that was known at the cutoff. points may carry `cutoff` in key."""
    y = F.log(F.greatest(F.col("y"), F.lit(LOG_FLOOR))) if log else F.col("y")
    df = points.withColumn("y", y).groupBy(*key).agg(*(F.sort_array(F.collect_list(F.when(c, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))).alias(n) for n, c in (("known", F.col("x") <= cutoff), ("future", F.col("x") > cutoff))))
    df = fit(df.filter((F.size("known") > 0) & (F.size("future") > 0)), "known")
    df = df.withColumn("mad", mad_sigma(_residuals(F.col("known"), F.col("slope"), F.col("intercept"))))
    ys = F.transform("known", lambda p: p["y"])
    sigma = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.greatest((F.array_max(ys) - F.array_min(ys)) * 1e-6, F.lit(1e-9)))
    top = F.array_max(_residuals(F.col("future"), F.col("slope"), F.col("intercept")))
    df = df.withColumn("future_sigma", F.least(top / sigma, F.lit(CAP)))
    return settled(df, key, future_sigma=F.col("future_sigma"), broke_out=F.col("future_sigma") >= k)


def features(points: DataFrame, key: list[str]) -> DataFrame:
    """Drift, volatility, last return, acceleration and drawdown of each series (3 returns at least, log returns of positive
    neighbours)."""
    df = gather(points, key)
    step = lambda p, i: F.when((p["y"] > 0) & (F.element_at("pts", i + 2)["y"] > 0), F.log(F.element_at("pts", i + 2)["y"] / p["y"]))
    df = df.withColumn("rets", F.filter(F.transform(F.slice("pts", F.lit(1), F.size("pts") - 1), step), lambda r: r.isNotNull())).withColumn("m", F.size("rets")).filter("m >= 3")
    df = df.withColumn("drift", mean_of(F.col("rets")))
    square = F.aggregate("rets", F.lit(0.0), lambda a, r: a + (r - F.col("drift")) * (r - F.col("drift")))
    ys = F.transform("pts", lambda p: p["y"])
    peak, now = F.array_max(ys), F.element_at("pts", -1)["y"]
    return settled(
        df, key, drift=F.col("drift"), vol=F.greatest(F.lit(1e-6), F.sqrt(square / (F.col("m") - 1))), last=F.element_at("rets", -1),
        accel=mean_of(F.slice("rets", -3, 3)) - F.col("drift"), drawdown=F.when(peak > 0, (now - peak) / peak).otherwise(0.0), value=now,
    )


def driver_status(feats: DataFrame, threshold: Column, fails_below: bool = True, confirm_up: bool = True, near: float = 1.0) -> DataFrame:
    """Where a driver stands: margin to its threshold in typical steps, trend, fast-clock partial and status."""
    from ..functions.stats import logistic

    signed = (F.col("value") - threshold) if fails_below else (threshold - F.col("value"))
    toward = F.col("drift") if confirm_up else -F.col("drift")
    df = feats.withColumn("signed", signed).withColumn("margin_sigma", F.col("signed") / F.greatest(F.abs("value") * F.col("vol"), F.lit(1e-9)))
    df = df.withColumn("trend_score", toward / F.col("vol"))
    trend = F.when(toward > F.col("vol") * 0.1, "toward_confirm").when(toward < -F.col("vol") * 0.1, "toward_falsify").otherwise("flat")
    df = df.withColumn("trend", trend)
    raw = F.lit(1.5) * F.col("margin_sigma") + F.lit(0.8) * F.col("trend_score")
    status = F.when(F.col("signed") >= 0, F.when((F.col("margin_sigma") < near) & (F.col("trend") == "toward_falsify"), "approaching").otherwise("on_track")).otherwise(F.when(F.col("trend") == "toward_confirm", "approaching").otherwise("falsified"))
    return df.withColumn("partial", logistic(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw)))).withColumn("status", status)
