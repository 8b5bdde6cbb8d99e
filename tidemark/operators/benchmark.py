"""Quantitative forecasts of benchmark questions ("will the value be higher on the resolution date?"), their combination and
their scoring. A history is gathered once per question; moves over h days are expressions over its array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import let, mean_of, median_of, normal_cdf, normal_cdf2, normal_quantile, pstdev_of
from .scoring import extremized

#: The drift of a market per trading day, years in which an old window's weight halves.
EQUITY_DRIFT, HALF_LIFE = 0.0003, 5.0


def histories(points: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (question, series_id, due, resolves) with h, their series' points (d date, v) up to the due date, ordered."""
    own = questions.join(points.filter("v IS NOT NULL"), "series_id", "left")
    return own.groupBy("question", "series_id", "due", "resolves").agg(F.array_sort(F.collect_list(F.when(F.col("d") <= F.col("due"), F.struct("d", "v")))).alias("h"))


def _moves(h: Column) -> Column:
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.element_at(h, i + 2).alias("b")))


def period_days(h: Column) -> Column:
    """The median distance of neighbouring points in whole days, 1 at least; null if no two dates differ."""
    gaps = F.filter(F.transform(_moves(h), lambda m: F.datediff(m["b"]["d"], m["a"]["d"])), lambda g: g > 0)
    return let(gaps, lambda g: F.when(F.size(g) > 0, F.greatest(F.lit(1), F.floor(median_of(g)).cast("int"))))


def _horizon() -> Column:
    return F.datediff("resolves", "due")


def drift_p(logs: bool = False) -> Column:
    """P(higher) of a random walk with drift; the drift counts by t^2 / (t^2 + 1) of its t. Null under 30 points."""
    h = F.col("h")
    logged = (F.array_min(F.transform(h, lambda p: p["v"])) > 0) & F.lit(logs)
    steps = F.transform(_moves(h), lambda m: F.when(logged, F.log(m["b"]["v"] / m["a"]["v"])).otherwise(m["b"]["v"] - m["a"]["v"]))

    def of(s: Column) -> Column:
        mu, n = mean_of(s), F.size(s)
        sd = let(pstdev_of(s), lambda x: F.when(x > 0, x).otherwise(1e-9))
        return let(F.struct(mu.alias("mu"), sd.alias("sd")), lambda m: let(m["mu"] / (m["sd"] / F.sqrt(n)), lambda t: m["mu"] * t * t / (t * t + 1) / m["sd"]))

    z = let(steps, of) * F.sqrt(_horizon() / period_days(h))
    return F.when((F.size(h) >= 30) & (_horizon() > 0), normal_cdf(z))


def equity_p() -> Column:
    """P(higher) of a stock: the market's drift against its own volatility. Null under 60 points or 30 returns."""
    days = _horizon() * 252 / 365
    plus = F.filter("h", lambda p: p["v"] > 0)
    rets = let(plus, lambda h: F.transform(_moves(h), lambda m: F.log(m["b"]["v"] / m["a"]["v"])))
    z = let(rets, lambda r: F.when(F.size(r) >= 30, F.lit(EQUITY_DRIFT) * F.sqrt(days) / let(pstdev_of(r), lambda x: F.when(x > 0, x).otherwise(1e-9))))
    return F.when((F.size("h") >= 60) & (days > 0), normal_cdf(z))


def seasonal(points: DataFrame, questions: DataFrame, window: int = 12) -> DataFrame:
    """question, p: the share of the series' values within `window` days of the year of the resolution that exceed the value at
    the due date, (k + 1) / (n + 2); only points up to the due date count. Null under 365 points or 15 in the pool."""
    own = questions.join(points.filter("v IS NOT NULL"), "series_id").filter("d <= due")
    apart = F.abs(F.dayofyear("d") - F.dayofyear("resolves"))
    near = F.least(apart, F.lit(366) - apart) <= window
    now = own.groupBy("question").agg(F.max_by("v", "d").alias("now"), F.count("*").alias("n"))
    pool = own.filter(near).join(now, "question").groupBy("question", "n").agg(F.count("*").alias("pool"), F.count_if(F.col("v") > F.col("now")).alias("k"))
    return pool.select("question", F.when((F.col("n") >= 365) & (F.col("pool") >= 15), (F.col("k") + 1) / (F.col("pool") + 2)).alias("p"))


def base_rate_p(half_life: float | None = HALF_LIFE) -> Column:
    """P(higher) as the share of past windows of the horizon's length that rose, recent ones weighing more; in [0.03, 0.97]. Null
    under 8 points or a weight of 3."""
    h = F.col("h")
    step = F.greatest(F.lit(1), F.bround(_horizon() / period_days(h), 0).cast("int"))

    def rate(s: Column) -> Column:
        ends = F.transform(F.slice(h, 1, F.greatest(F.size(h) - s, F.lit(0))), lambda p, i: F.struct(p["v"].alias("a"), F.element_at(h, i + 1 + s).alias("b")))
        weight = lambda e: F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), F.datediff("due", e["b"]["d"]) / 365.25 / half_life)
        start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("all"))
        add = lambda t, e: F.struct((t["up"] + F.when(e["b"]["v"] > e["a"], weight(e)).otherwise(0.0)).alias("up"), (t["all"] + weight(e)).alias("all"))
        return F.aggregate(ends, start, add, lambda t: F.when(t["all"] >= 3, F.greatest(F.lit(0.03), F.least(F.lit(0.97), t["up"] / t["all"]))))

    return F.when((F.size(h) >= 8) & (F.size(h) > step), let(step, rate))


def sign_correlation(points: DataFrame, pairs: DataFrame, step: int = 1, least: int = 20) -> DataFrame:
    """pairs (a, b, due) with rho: the correlation of the signs of both series' moves over `step` points from common dates, within
    0.9, times n / (n + 30); 0 under `least` common dates or without variation."""
    from pyspark.sql import Window

    ahead = F.lead("v", step).over(Window.partitionBy("series_id").orderBy("d"))
    ends = F.lead("d", step).over(Window.partitionBy("series_id").orderBy("d"))
    ups = points.withColumn("up", (ahead > F.col("v")).cast("double")).withColumn("end", ends).filter("end IS NOT NULL").select("series_id", "d", "end", "up")
    side = lambda n: ups.toDF(n, "d", f"end_{n}", f"up_{n}")
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "d"]).filter("end_a <= due AND end_b <= due")
    n, sa, sb, sab, saa, sbb = F.count("*").cast("double"), F.sum("up_a"), F.sum("up_b"), F.sum(F.col("up_a") * F.col("up_b")), F.sum("up_a"), F.sum("up_b")  # up^2 = up
    g = both.groupBy("a", "b", "due").agg(n.alias("n"), (sab * n - sa * sb).alias("cov"), (saa * n - sa * sa).alias("va"), (sbb * n - sb * sb).alias("vb"))
    rho = F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))) * F.col("n") / (F.col("n") + 30)
    g = g.select("a", "b", "due", F.when((F.col("n") >= least) & (F.col("va") > 0) & (F.col("vb") > 0), rho).otherwise(0.0).alias("rho"))
    return pairs.join(g, ["a", "b", "due"], "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def joint_up(p1: Column, p2: Column, rho: Column) -> Column:
    """P(both) under a Gaussian copula, within the bounds that p1 and p2 allow; p1 * p2 for a correlation next to nothing."""
    j = normal_cdf2(normal_quantile(p1), normal_quantile(p2), rho)
    return F.when(F.abs(rho) < 1e-3, p1 * p2).otherwise(F.least(p1, p2, F.greatest(F.lit(0.0), p1 + p2 - 1, j)))


def combos(pairs: DataFrame) -> DataFrame:
    """pairs (p1, p2, rho) -> four rows each, for the directions (1, 1), (1, -1), (-1, 1), (-1, -1): d1, d2, forecast."""
    df = pairs.withColumn("j", joint_up(F.col("p1"), F.col("p2"), F.col("rho")))
    cells = [(1, 1, F.col("j")), (1, -1, F.col("p1") - F.col("j")), (-1, 1, F.col("p2") - F.col("j")), (-1, -1, 1 - F.col("p1") - F.col("p2") + F.col("j"))]
    rows = F.array(*[F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 6).alias("forecast")) for a, b, p in cells])
    return df.select(*[c for c in pairs.columns if c not in ("p1", "p2", "rho")], F.inline(rows))


def _steps(x: Column, *upto: tuple[float, float], beyond: float) -> Column:
    col = F.lit(beyond)
    for most, p in reversed(upto):
        col = F.when(x <= most, p).otherwise(col)
    return col


def prior_p(text: Column, days: Column) -> Column:
    """The prior of a question that no series answers, by its kind and its horizon in days. The table."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("vaccine"), 0.02)
        .when(t.contains("world record"), _steps(days, (550, 0.96), (1825, 0.85), beyond=0.70))
        .when(t.contains("elo rating"), _steps(days, (120, 0.03), (270, 0.05), (550, 0.08), beyond=0.12))
        .when(t.contains("ranking") & t.contains("as high or higher"), _steps(days, (10, 0.88), (45, 0.66), (120, 0.50), (270, 0.43), (550, 0.39), beyond=0.33))
        .otherwise(_steps(days, (30, 0.26), beyond=0.20))
    )


def conflict_prior(baseline: Column) -> Column:
    """The prior of a tenfold rise by the value at the freeze. The table."""
    return F.when(baseline.isNull(), 0.05).otherwise(_steps(baseline, (1.0, 0.05), (3.0, 0.14), beyond=0.23))


def routed(questions: DataFrame, *models: tuple[str, DataFrame]) -> DataFrame:
    """questions (question, source) with p: that of the model whose name the source is, else one half."""
    df, p = questions, F.lit(None).cast("double")
    for name, model in models:
        df = df.join(model.select("question", F.col("p").alias(f"p_{name}")), "question", "left")
        p = F.when(F.col("source") == name, F.col(f"p_{name}")).otherwise(p)
    return df.select(*questions.columns, F.coalesce(p, F.lit(0.5)).alias("p"))


def filled(questions: DataFrame, crowd: DataFrame, quant: DataFrame, replies: DataFrame) -> DataFrame:
    """question, source, p, how. A signal wins (the crowd's on markets, the model's elsewhere); a reply only fills a gap; what is
    left is one half."""
    df = questions.join(crowd.select("question", F.col("p").alias("c")), "question", "left").join(quant.select("question", F.col("p").alias("q")), "question", "left").join(replies.select("question", F.col("p").alias("r")), "question", "left")
    signal = F.when(F.col("market") & F.col("c").isNotNull(), extremized(F.col("c"))).when(~F.col("market"), F.col("q"))
    how = F.when(signal.isNotNull(), F.when(F.col("market"), "crowd").otherwise("quant")).when(F.col("r").isNotNull(), "reply").otherwise("half")
    return df.select("question", "source", "market", F.coalesce(signal, "r", F.lit(0.5)).alias("p"), how.alias("how"))


def score(resolutions: DataFrame, forecasts: DataFrame) -> DataFrame:
    """resolutions (question, source, market, resolves, direction, outcome) with p and missing: markets match by question and
    direction whatever the date, others by the date as well; a missing forecast counts as one half."""
    own = forecasts.select("question", "direction", "resolves", F.col("p").alias("given"))
    any_date = own.groupBy("question", "direction").agg(F.max_by("given", "resolves").alias("by_id"))
    exact = own.groupBy("question", "direction", "resolves").agg(F.max("given").alias("by_date"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    df = resolutions.join(any_date, same(resolutions, any_date, ["question", "direction"]), "left").drop(any_date["question"]).drop(any_date["direction"])
    df = df.join(exact, same(df, exact, ["question", "direction", "resolves"]), "left").drop(exact["question"]).drop(exact["direction"]).drop(exact["resolves"])
    p = F.when(F.col("market"), F.col("by_id")).otherwise(F.col("by_date"))
    return df.withColumn("missing", p.isNull()).withColumn("p", F.coalesce(p, F.lit(0.5))).withColumn("brier", F.pow(F.col("p") - F.col("outcome"), 2)).drop("by_id", "by_date")


def brier_by_source(scored: DataFrame) -> DataFrame:
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.avg("brier").alias("brier"))


def submission_score(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """overall (weighted by rows), pooled (markets and others alike), market, dataset, n, missing."""
    g = scored.groupBy(*by).agg(F.avg("brier").alias("overall"), F.avg(F.when(F.col("market"), F.col("brier"))).alias("market"), F.avg(F.when(~F.col("market"), F.col("brier"))).alias("dataset"), F.count("*").alias("n"), F.count_if("missing").alias("missing"))
    return g.withColumn("pooled", (F.coalesce("market", "dataset") + F.coalesce("dataset", "market")) / 2)


def coverage(questions: DataFrame, forecasts: DataFrame, least: float = 0.95) -> DataFrame:
    """market, n, covered, enough: the share of questions of each side with a forecast."""
    has = questions.join(forecasts.select("question", F.lit(1).alias("has")).distinct(), "question", "left")
    g = has.groupBy("market").agg(F.count("*").alias("n"), (F.count("has") / F.count("*")).alias("covered"))
    return g.withColumn("enough", F.col("covered") >= least)


def parsed_reply(reply: Column) -> Column:
    """The probability in a model's reply: that of its last flat JSON object which has one, within [0.03, 0.97]; null without."""
    objects = F.regexp_extract_all(reply, F.lit(r"\{[^{}]*\}"), F.lit(0))
    p = F.transform(objects, lambda o: F.get_json_object(o, "$.probability").try_cast("double"))
    good = F.filter(p, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(good) > 0, F.greatest(F.lit(0.03), F.least(F.lit(0.97), F.element_at(good, -1))))


def leak_free(answers: DataFrame, cutoff: Column) -> DataFrame:
    """n, brier, brier_base, brier_half, hit_rate of the answers (determined year, p, outcome) whose outcome was determined after
    the model's cutoff year; others could have been remembered. An answer without p is skipped."""
    ok = answers.filter((cutoff < F.col("determined")) & F.col("p").isNotNull())
    y = F.col("outcome").cast("double")
    g = ok.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(y).alias("base"), F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("double")).alias("hit_rate"))
    return g.select("n", "brier", (F.col("base") * (1 - F.col("base"))).alias("brier_base"), F.lit(0.25).alias("brier_half"), "hit_rate")
