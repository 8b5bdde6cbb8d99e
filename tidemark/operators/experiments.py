"""Pre-registered experiments, frozen cases, recall probes and the locator of binding layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log_loss, logistic, theil_sen_slope, upper_median
from .backtest import refuse_sealed
from .series import LOG_FLOOR, detect, gather

DECLARED = 27


# Ledger of an experiment: rows (protocol, split, config, n_scored, lift, p_block, at).
def ledger(rows: DataFrame) -> DataFrame:
    """The last row of each (protocol, split, config), with n_seen (distinct configurations of the protocol, 27 at least) and, on
    reveals only, the deflated p."""
    key = ["protocol", "split", "config"]
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "at").alias("r")).select(*key, "r.*")
    seen = rows.groupBy("protocol").agg(F.greatest(F.count_distinct("config"), F.lit(DECLARED)).alias("n_seen"))
    return last.join(seen, "protocol").withColumn("p_deflated", F.when(F.col("split") == "test", F.least(F.lit(1.0), F.col("p_block") * F.col("n_seen"))))


def promoted(led: DataFrame) -> DataFrame:
    """protocol, config, k, lift of the selected configuration: the greatest lift on the selection split, ties to the larger k, among
    those with scored cases."""
    sel = led.filter("split = 'select' AND n_scored > 0")
    best = F.max_by(F.struct("config", "k", "lift"), F.struct(F.coalesce("lift", F.lit(0.0)), "k", "config"))
    return sel.groupBy("protocol").agg(best.alias("b")).select("protocol", "b.*")


def reveal_once(led: DataFrame, protocol: int) -> None:
    """Refuses a second reveal of a protocol's test split."""
    if not led.filter((F.col("protocol") == protocol) & (F.col("split") == "test")).isEmpty():
        raise ValueError(f"protocol {protocol} has been revealed")


def run_configs(cases: DataFrame, ks: list[float], margins: list[float], channels=("count", "diffusion", "talent"), origins=()) -> DataFrame:
    """k, margin, channels and the 2 x 2 counts with lift, pooled and on each series' earliest origin (lift_declustered), of every
    configuration. cases: series_id, origin, surprise, multiple, diffusion, talent (surprises of the orthogonal channels, null where
    unmeasured). 'count' fires by the surprise, the other channels also by their own. Nothing but thresholds depends on the
    configuration, so all of them are read off one frame."""
    from .inference import confusion

    refuse_sealed(origins)
    grid = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(m)).alias("margin"), F.lit(c).alias("channels")) for k in ks for m in margins for c in channels])
    x = cases.filter("surprise IS NOT NULL AND multiple IS NOT NULL").withColumn("g", F.explode(grid))
    over = lambda c: F.coalesce(F.col(c) >= F.col("g.k"), F.lit(False))
    fired = over("surprise") | (F.col("g.channels").isin("diffusion", "talent") & over("diffusion")) | ((F.col("g.channels") == "talent") & over("talent"))
    x = x.select("g.*", "series_id", "origin", fired.alias("fired"), (F.col("multiple") >= F.col("g.margin")).alias("winner"))
    key = ["k", "margin", "channels"]
    first = x.groupBy(*key, "series_id").agg(F.min_by(F.struct("fired", "winner"), "origin").alias("e")).select(*key, "e.*")
    one = confusion(first, key).select(*key, F.col("n").alias("n_declustered"), F.col("lift").alias("lift_declustered"))
    return confusion(x, key).join(one, key)


def configurations_seen(led: DataFrame) -> DataFrame:
    """n: distinct (protocol, config) over all protocols."""
    return led.agg(F.count_distinct("protocol", "config").alias("n"))


def power_verdict(mde: Column) -> Column:
    """What a null result says at that detectable lift: well powered up to 1.7, under-powered from 2.5 or off the grid."""
    return F.when(mde.isNull() | (mde >= 2.5), "under-powered").when(mde <= 1.7, "well-powered null").otherwise("borderline")


# Orthogonal channels of the universe.
def channel_verdicts(points: DataFrame, origins: list[int], k: float) -> DataFrame:
    """series_id, origin, surprise, fired of a channel's yearly series at each origin, log space; no row under eight known points."""
    known = points.withColumn("origin", F.explode(F.array(*map(F.lit, origins)))).filter("x <= origin")
    return detect(known, ["series_id", "origin"], k, log=True).select("series_id", "origin", "surprise", "fired")


def channel_report(cases: DataFrame) -> DataFrame:
    """measured, both, rescued (winners that only the channel fires on), cost (false alarms that only it raises): cases (fired,
    channel, winner)."""
    f, c, w = F.col("fired"), F.col("channel"), F.col("winner")
    return cases.filter(c.isNotNull() & f.isNotNull() & w.isNotNull()).agg(F.count("*").alias("measured"), F.count_if(f & c).alias("both"), F.count_if(~f & c & w).alias("rescued"), F.count_if(~f & c & ~w).alias("cost"))


# Frozen cases.
def retro(cases: DataFrame, points: DataFrame, k: float = 3.0) -> DataFrame:
    """cases (case, category, signal, consensus, capturable) with verdict, sigma, p, correct, lead_months under the frozen rule on
    points (case, x, y) up to the signal year, log space. Not capturable: rejected; under eight points: insufficient."""
    known = points.join(cases.select("case", "signal"), "case").filter("x <= signal")
    n = known.groupBy("case").agg(F.count("*").alias("n"))
    det = detect(known, ["case"], k, log=True).select("case", "surprise", "fired", "sustained")
    df = cases.join(n, "case", "left").join(det, "case", "left")
    verdict = F.when(~F.col("capturable") | F.col("n").isNull(), "not_capturable").when(F.col("surprise").isNull(), "insufficient_data").when(F.col("fired"), "fired").otherwise("silent")
    p = F.bround(logistic(F.when(verdict.isin("fired", "silent"), F.col("surprise")).otherwise(0.0) - k), 3)
    df = df.withColumn("verdict", verdict).withColumn("p", p).withColumn("outcome", (F.col("category") == "winner").cast("int"))
    hit = F.col("verdict") == "fired"
    lead = F.when(hit & (F.col("outcome") == 1) & F.col("consensus").isNotNull(), F.greatest(F.lit(0), (F.col("consensus") - F.col("signal")) * 12))
    return df.select("case", "category", "verdict", F.col("surprise").alias("sigma"), "sustained", "p", "outcome", (hit == (F.col("outcome") == 1)).alias("correct"), lead.alias("lead_months"))


def retro_score(cases: DataFrame) -> DataFrame:
    """n, base_rate, precision, recall, specificity, lift, median_lead (the upper median), Brier and log loss against the base rate."""
    f, y = F.col("verdict") == "fired", F.col("outcome") == 1
    g = cases.agg(
        F.count("*").alias("n"), F.count_if(y).alias("winners"), F.count_if(f).alias("fires"), F.count_if(f & y).alias("tp"), F.count_if(~f & ~y).alias("tn"), F.sort_array(F.collect_list(F.when(f & y, F.col("lead_months")))).alias("leads"),
        F.avg(F.pow(F.col("p") - F.col("outcome"), 2)).alias("brier"), F.avg(log_loss(F.col("p"), F.col("outcome"))).alias("log_loss"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    base = div(F.col("winners"), F.col("n"))
    g = g.withColumn("base_rate", base).withColumn("precision", div(F.col("tp"), F.col("fires"))).withColumn("recall", div(F.col("tp"), F.col("winners"))).withColumn("specificity", div(F.col("tn"), F.col("n") - F.col("winners")))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("base_rate")))
    naive = -(F.col("base_rate") * F.log(q) + (1 - F.col("base_rate")) * F.log(1 - q))
    return g.select("n", "base_rate", "precision", "recall", "specificity", div(F.col("precision"), F.col("base_rate")).alias("lift"), F.when(F.size("leads") > 0, upper_median(F.col("leads"))).alias("median_lead"), "brier", (F.col("base_rate") * (1 - F.col("base_rate"))).alias("brier_base"), "log_loss", naive.alias("log_loss_base"))


def recall_probe(probes: DataFrame, points: DataFrame, cutoffs: list[int], k: float = 3.0) -> DataFrame:
    """probes (series_id, kind, signal) with first_fire, first_sigma, lead_years, verdict and trace (cutoff -> fired, sigma) of the
    detector at each cutoff, log space. A winner gains recall by firing before its signal year; a fizzle must stay silent."""
    known = points.join(probes.select("series_id"), "series_id", "left_semi").withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).filter("x <= cutoff")
    det = detect(known, ["series_id", "cutoff"], k, log=True).select("series_id", "cutoff", "surprise", "fired")
    g = det.groupBy("series_id").agg(F.min(F.when(F.col("fired"), F.struct("cutoff", F.bround("surprise", 2).alias("sigma")))).alias("first"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cutoff").cast("string"), F.struct("fired", F.bround("surprise", 2).alias("sigma")))))).alias("trace"))
    df = probes.join(g, "series_id", "left")
    first = F.col("first.cutoff")
    lead = F.when((F.col("kind") == "winner") & (first < F.col("signal")), F.col("signal") - first)
    fired = first.isNotNull()
    verdict = F.when(F.col("kind") == "winner", F.when(lead.isNotNull(), "recall_gain").otherwise("no_gain")).when(F.col("kind") == "commercial_fizzle", F.when(fired, "research_fired").otherwise("silent")).otherwise(F.when(fired, "false_positive").otherwise("silent_correct"))
    return df.select("series_id", "kind", first.alias("first_fire"), F.col("first.sigma").alias("first_sigma"), lead.alias("lead_years"), verdict.alias("verdict"), "trace")


# Locator.
def locate(prices: DataFrame, origins: list[int], k: float = 3.0, window: int = 4, least: int = 5) -> DataFrame:
    """origin, n_layers, located, obvious, winner, multiple, hit, obvious_hit. prices: layer, x (fractional year), year, y.

    A layer's score is its surprise in log prices up to the origin (the log slope where the detector cannot judge); the obvious
    layer has the steepest log slope; the winner the greatest log rise from its last known price to the mean of the next `window`
    years. Layers need `least` known prices and a future; an origin two layers. All origins share one gathered array."""
    at = F.explode(F.array(*map(F.lit, origins)))
    ys = prices.withColumn("origin", at)
    det = detect(ys.filter("year <= origin"), ["layer", "origin"], k, log=True).select("layer", "origin", "surprise")
    logs = ys.filter("year <= origin").withColumn("y", F.log(F.greatest("y", F.lit(LOG_FLOOR))))
    slope = gather(logs, ["layer", "origin"]).filter(F.size("pts") >= least).select("layer", "origin", theil_sen_slope(F.col("pts")).alias("slope"))
    g = ys.groupBy("layer", "origin").agg(F.max_by(F.when(F.col("year") <= F.col("origin"), F.col("y")), F.when(F.col("year") <= F.col("origin"), F.col("x"))).alias("last"), F.avg(F.when((F.col("year") > F.col("origin")) & (F.col("year") <= F.col("origin") + window), F.col("y"))).alias("next"))
    c = slope.join(g, ["layer", "origin"]).join(det, ["layer", "origin"], "left").filter("last > 0 AND next > 0")
    c = c.withColumn("score", F.coalesce("surprise", "slope")).withColumn("rise", F.log(F.col("next") / F.col("last")))
    top = lambda by: F.max_by("layer", F.struct(by, "layer"))
    o = c.groupBy("origin").agg(F.count("*").alias("n_layers"), top("score").alias("located"), top("slope").alias("obvious"), top("rise").alias("winner"), F.max("rise").alias("rise")).filter("n_layers >= 2")
    return o.select("origin", "n_layers", "located", "obvious", "winner", F.exp("rise").alias("multiple"), (F.col("located") == F.col("winner")).alias("hit"), (F.col("obvious") == F.col("winner")).alias("obvious_hit"))


def hit_rates(located: DataFrame) -> DataFrame:
    """n, hit_rate, obvious_rate and chance (the mean of one over the number of layers)."""
    return located.agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.col("obvious_hit").cast("double")).alias("obvious_rate"), F.avg(1 / F.col("n_layers")).alias("chance"))
