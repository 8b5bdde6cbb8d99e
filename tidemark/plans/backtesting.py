"""Inference, back-tests and experiments as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import experiments
from ..operators import inference as inf
from ..operators import discovery, series
from ..sources import domain
from ..streaming.flows import cut
from .catalog import MONTHLY, QUARTERLY, detect_sql, med, query

ORIGINS = (7991, 7995, 7999)  # the last quarters of 1997, 1998 and 1999
MARGIN = 1.02  # on near-stationary data the registered 1.5 has no winner; the production margin is tested on fixtures
_R6 = lambda *names: {c: F.round(c, 6) for c in names}

_SHARES = f"""{QUARTERLY},
tot AS (SELECT cohort, x, sum(y) AS total, count(DISTINCT series_id) AS m FROM yr GROUP BY ALL),
mem AS (SELECT cohort, max(m) AS members FROM tot GROUP BY ALL),
sh AS (SELECT series_id, cohort, yr.x, y, total, members, CASE WHEN total <> 0 THEN y / total END AS share FROM yr JOIN tot USING (cohort, x) JOIN mem USING (cohort))"""
_GAINS = f"""{_SHARES},
o AS (SELECT unnest([7991, 7995, 7999]) AS origin),
k AS (SELECT series_id, cohort, origin, count(*) FILTER (WHERE x <= origin) AS n_known, count(*) FILTER (WHERE x > origin) AS n_future,
  avg(share) FILTER (WHERE x <= origin AND x > origin - 3 AND share <> 0) AS before FROM sh, o WHERE members >= 5 GROUP BY ALL),
f AS (SELECT series_id, cohort, origin, x, share, dense_rank() OVER (PARTITION BY series_id, cohort, origin ORDER BY x DESC) AS back FROM sh, o WHERE members >= 5 AND x > origin),
a AS (SELECT series_id, cohort, origin, avg(share) FILTER (WHERE back <= 3 AND share <> 0) AS after FROM f GROUP BY ALL),
ld AS (SELECT series_id, cohort, origin, min(x) AS fx FROM f JOIN k USING (series_id, cohort, origin) WHERE share <> 0 AND share / before >= {MARGIN} GROUP BY ALL),
gain AS (SELECT series_id, cohort, origin, n_known, n_future, least(after / before, 1e6) AS multiple, least(after / before, 1e6) >= {MARGIN} AS winner, fx - origin AS lead
  FROM k JOIN a USING (series_id, cohort, origin) LEFT JOIN ld USING (series_id, cohort, origin) WHERE n_known >= 8 AND n_future >= 3)"""


@query("cohort_totals", f"WITH {_SHARES} SELECT DISTINCT cohort, x, total, members FROM sh")
def cohort_totals(spark, sf_dir):
    return bt.cohort_totals(domain.quarterly(spark, sf_dir), ["cohort"])


def _gains(spark, sf_dir):
    return bt.gain_share(bt.shares(domain.quarterly(spark, sf_dir), ["cohort"]), ["series_id", "cohort"], list(ORIGINS), MARGIN)


@query("gain_share_sweep", f"WITH {_GAINS} SELECT series_id, cohort, origin, n_known, n_future, round(multiple, 6) AS multiple, winner, lead FROM gain")
def gain_share_sweep(spark, sf_dir):
    return _gains(spark, sf_dir).withColumns(_R6("multiple"))


_KNOWN = f"""{MONTHLY}, o AS (SELECT unnest([7991, 7995, 7999]) AS origin),
pit AS (SELECT series_id, origin, x, y FROM pts, o WHERE x <= (origin // 4) * 12 + 12)"""


#: The last month known at each origin, a quarter.
_MONTHS = {o: o // 4 * 12 + 12 for o in ORIGINS}


def _judged(spark, sf_dir, k: float = 3.0):
    return series.detect_at(domain.monthly(spark, sf_dir), ["series_id"], _MONTHS, k)


@query("point_in_time_verdicts", f"WITH {_KNOWN}, {detect_sql('pit', 'series_id, origin')} SELECT series_id, origin, n, round(surprise, 6) AS surprise, fired FROM det")
def point_in_time_verdicts(spark, sf_dir):
    """The detector at every origin, on what was known then: one pass for all origins."""
    return _judged(spark, sf_dir).select("series_id", "origin", "n", F.round("surprise", 6).alias("surprise"), "fired")


_EVENTS = f"{_KNOWN}, {detect_sql('pit', 'series_id, origin', 1.5)}, {_GAINS.replace('o AS (SELECT unnest([7991, 7995, 7999]) AS origin),', '')}, ev AS (SELECT series_id, cohort, origin, surprise, fired, winner FROM det JOIN gain USING (series_id, origin))"
_CONF = """count(*) FILTER (WHERE fired AND winner) AS a, count(*) FILTER (WHERE fired AND NOT winner) AS b, count(*) FILTER (WHERE NOT fired AND winner) AS c, count(*) FILTER (WHERE NOT fired AND NOT winner) AS d"""
_RATES = """a, b, c, d, a + b + c + d AS n, round(CASE WHEN a + b + c + d > 0 THEN (a + c) / (a + b + c + d) ELSE 0 END, 6) AS base_rate,
  round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 6) AS precision, round(CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0 END, 6) AS recall,
  round(CASE WHEN c + d > 0 THEN c / (c + d) ELSE 0 END, 6) AS silent_rate,
  round(CASE WHEN a + b > 0 AND a + c > 0 THEN (a / (a + b)) / ((a + c) / (a + b + c + d)) ELSE 0 END, 6) AS lift"""


def _events(spark, sf_dir):
    det = _judged(spark, sf_dir, 1.5).select("series_id", "origin", "surprise", "fired")
    return det.join(_gains(spark, sf_dir).select("series_id", "cohort", "origin", "winner"), ["series_id", "origin"])


def _rates(df):
    return df.withColumns(_R6("base_rate", "precision", "recall", "silent_rate", "lift"))


@query("backtest_by_origin", f"WITH {_EVENTS}, cf AS (SELECT origin, {_CONF} FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL GROUP BY ALL) SELECT origin, {_RATES} FROM cf")
def backtest_by_origin(spark, sf_dir):
    return _rates(inf.confusion(_events(spark, sf_dir), ["origin"]))


@query("backtest_pooled", f"WITH {_EVENTS}, cf AS (SELECT {_CONF} FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL) SELECT {_RATES} FROM cf")
def backtest_pooled(spark, sf_dir):
    return _rates(inf.confusion(_events(spark, sf_dir)))


@query("backtest_declustered", f"WITH {_EVENTS}, e1 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY origin) AS rn FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL), cf AS (SELECT {_CONF} FROM e1 WHERE rn = 1) SELECT {_RATES} FROM cf")
def backtest_declustered(spark, sf_dir):
    return _rates(inf.confusion(bt.earliest(_events(spark, sf_dir))))


@query("brier_of_surprise", f"""WITH {_EVENTS}, p AS (SELECT 1 / (1 + exp(-(surprise - 1.5::DOUBLE))) AS p, winner::INT AS w, avg(winner::INT) OVER () AS base FROM ev WHERE winner IS NOT NULL)
SELECT count(*) AS n, round(avg(pow(p - w, 2)), 6) AS brier_model, round(avg(pow(base - w, 2)), 6) AS brier_base FROM p""")
def brier_of_surprise(spark, sf_dir):
    """Brier of logistic(surprise - k) against that of the base rate, which is base * (1 - base)."""
    w = F.col("winner").cast("double")
    e = _events(spark, sf_dir).filter("winner IS NOT NULL")
    return e.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(1 / (1 + F.exp(-(F.col("surprise") - 1.5))) - w, 2)), 6).alias("brier_model"), F.round(F.avg(w) * (1 - F.avg(w)), 6).alias("brier_base"))


@query("leave_one_origin_out", f"""WITH {_EVENTS},
lo AS (SELECT origin, {_CONF} FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL GROUP BY ALL),
ot AS (SELECT h.origin, h.a, h.b, h.c, h.d, sum(o.a) AS oa, sum(o.b) AS ob, sum(o.c) AS oc, sum(o.d) AS od FROM lo h JOIN lo o ON o.origin <> h.origin GROUP BY ALL),
pr AS (SELECT *, (oa + oc) / (oa + ob + oc + od) AS base, coalesce(oa / nullif(oa + ob, 0), (oa + oc) / (oa + ob + oc + od)) AS pf, coalesce(oc / nullif(oc + od, 0), (oa + oc) / (oa + ob + oc + od)) AS ps FROM ot)
SELECT round(sum(a * pow(pf - 1, 2) + b * pow(pf, 2) + c * pow(ps - 1, 2) + d * pow(ps, 2)) / sum(a + b + c + d), 6) AS brier_model,
  round(sum((a + c) * pow(base - 1, 2) + (b + d) * pow(base, 2)) / sum(a + b + c + d), 6) AS brier_base, sum(a + b + c + d)::BIGINT AS n FROM pr""")
def leave_one_origin_out(spark, sf_dir):
    return bt.leave_one_origin_out(_events(spark, sf_dir)).withColumns(_R6("brier_model", "brier_base"))


@query("breakout_after_cutoff", f"""WITH {MONTHLY},
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x) AS rn FROM pts WHERE x <= 1999 * 12 + 12), fu AS (SELECT * FROM pts WHERE x > 1999 * 12 + 12),
sl AS (SELECT a.series_id, list((b.y - a.y) / (b.x - a.x)) AS s FROM k a JOIN k b USING (series_id) WHERE a.rn < b.rn GROUP BY ALL),
s2 AS (SELECT series_id, coalesce({med('s')}, 0) AS slope FROM (SELECT DISTINCT series_id FROM k) LEFT JOIN sl USING (series_id)),
ic AS (SELECT series_id, slope, list(y - slope * x) AS c, list(y) AS ys FROM k JOIN s2 USING (series_id) GROUP BY ALL),
i2 AS (SELECT series_id, slope, {med('c')} AS intercept, list_max(ys) - list_min(ys) AS span FROM ic),
e AS (SELECT series_id, list(y - (slope * x + intercept)) AS es FROM k JOIN i2 USING (series_id) GROUP BY ALL),
e2 AS (SELECT series_id, es, {med('es')} AS mid FROM e),
sg AS (SELECT series_id, 1.4826::DOUBLE * {med('list_transform(es, lambda v: abs(v - mid))')} AS mad FROM e2),
r AS (SELECT fu.series_id, max(fu.y - (slope * fu.x + intercept)) AS top, any_value(CASE WHEN mad > 0 THEN mad ELSE greatest(span * 1e-6, 1e-9) END) AS sigma FROM fu JOIN i2 USING (series_id) JOIN sg USING (series_id) GROUP BY ALL)
SELECT series_id, round(least(top / sigma, 1e6), 6) AS future_sigma, least(top / sigma, 1e6) >= 3 AS broke_out FROM r""")
def breakout_after_cutoff(spark, sf_dir):
    return series.breakout(domain.monthly(spark, sf_dir), ["series_id"], F.lit(1999 * 12 + 12)).withColumns(_R6("future_sigma"))


@query("measurable_series", f"WITH {MONTHLY} SELECT series_id, round(median(sqrt(greatest(y, 0))), 6) AS snr, median(sqrt(greatest(y, 0))) >= 3 AS measurable FROM pts WHERE x <= 1999 * 12 + 12 GROUP BY ALL")
def measurable_series(spark, sf_dir):
    return bt.measurable(domain.monthly(spark, sf_dir), ["series_id"], F.lit(1999 * 12 + 12)).withColumns(_R6("snr"))


def _channel_sql(name: str, column: str) -> str:
    return f"{name} AS (WITH pts AS (SELECT p_brand || '|' || p_type AS series_id, (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE AS x, ln(greatest(count(DISTINCT {column}), 0.5::DOUBLE)) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), pit AS (SELECT series_id, origin, x, y FROM pts, o WHERE x <= (origin // 4) * 12 + 12), {detect_sql('pit', 'series_id, origin')} SELECT series_id, origin, surprise AS {name} FROM det)"


_GRID = f"""{_EVENTS}, {_channel_sql('diffusion', 'l_suppkey')}, {_channel_sql('talent', 'l_orderkey')},
cases AS (SELECT series_id, origin, ev.surprise, multiple, diffusion, talent FROM ev JOIN gain USING (series_id, origin) LEFT JOIN diffusion USING (series_id, origin) LEFT JOIN talent USING (series_id, origin) WHERE multiple IS NOT NULL)"""


def _channel(spark, sf_dir, column, name):
    part = domain.table(spark, sf_dir, "part").select("p_partkey", domain.series_name().alias("series_id"))
    items = domain.table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("x"), column).distinct()
    pts = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("series_id", "x").agg(F.count_distinct(column).alias("y"))
    return series.detect_at(pts, ["series_id"], _MONTHS, log=True).select("series_id", "origin", F.col("surprise").alias(name))


def _cases(spark, sf_dir):
    det = _judged(spark, sf_dir).select("series_id", "origin", "surprise")
    df = det.join(_gains(spark, sf_dir).select("series_id", "origin", "multiple"), ["series_id", "origin"]).filter("multiple IS NOT NULL")
    for column, name in (("l_suppkey", "diffusion"), ("l_orderkey", "talent")):
        df = df.join(_channel(spark, sf_dir, column, name), ["series_id", "origin"], "left")
    return df


@query("configuration_grid", f"""WITH {_GRID},
g AS (SELECT k::DOUBLE AS k, margin::DOUBLE AS margin, channels FROM (SELECT unnest([1.0, 1.5, 2.0]) AS k), (SELECT unnest([1.0, 1.02, 1.1]) AS margin), (SELECT unnest(['count', 'diffusion', 'talent']) AS channels)),
x AS (SELECT k, margin, channels, series_id, origin, surprise >= k OR (channels <> 'count' AND coalesce(diffusion >= k, false)) OR (channels = 'talent' AND coalesce(talent >= k, false)) AS fired, multiple >= margin AS winner FROM cases, g),
cf AS (SELECT k, margin, channels, {_CONF} FROM x GROUP BY ALL),
e1 AS (SELECT *, row_number() OVER (PARTITION BY k, margin, channels, series_id ORDER BY origin) AS rn FROM x),
cd AS (SELECT k, margin, channels, {_CONF} FROM e1 WHERE rn = 1 GROUP BY ALL), rd AS (SELECT k, margin, channels, {_RATES} FROM cd)
SELECT k, margin, channels, {_RATES}, (SELECT n FROM rd WHERE rd.k = cf.k AND rd.margin = cf.margin AND rd.channels = cf.channels) AS n_declustered, (SELECT lift FROM rd WHERE rd.k = cf.k AND rd.margin = cf.margin AND rd.channels = cf.channels) AS lift_declustered FROM cf""")
def configuration_grid(spark, sf_dir):
    """All 27 configurations from one evaluation: surprise, multiple and the channels are computed once, the grid only thresholds
    them."""
    got = experiments.run_configs(_cases(spark, sf_dir), [1.0, 1.5, 2.0], [1.0, 1.02, 1.1], origins=[o // 4 for o in ORIGINS])
    return _rates(got).withColumn("lift_declustered", F.round("lift_declustered", 6))


@query("channel_report", f"WITH {_GRID}, c AS (SELECT surprise >= 1.5 AS fired, diffusion >= 1.5 AS channel, multiple >= {MARGIN} AS winner FROM cases WHERE diffusion IS NOT NULL) SELECT count(*) AS measured, count(*) FILTER (WHERE fired AND channel) AS both, count(*) FILTER (WHERE NOT fired AND channel AND winner) AS rescued, count(*) FILTER (WHERE NOT fired AND channel AND NOT winner) AS cost FROM c")
def channel_report(spark, sf_dir):
    """What the diffusion channel adds to the count channel: winners rescued, false alarms paid."""
    c = _cases(spark, sf_dir).select((F.col("surprise") >= 1.5).alias("fired"), (F.col("diffusion") >= 1.5).alias("channel"), (F.col("multiple") >= MARGIN).alias("winner"))
    return experiments.channel_report(c)


@query("universe_board", f"WITH {_EVENTS} SELECT series_id, origin, round(surprise, 6) AS surprise, fired, winner, fired = winner AS correct FROM ev ORDER BY origin, series_id")
def universe_board(spark, sf_dir):
    """The universe's cases by origin and name."""
    e = _events(spark, sf_dir)
    return e.select("series_id", "origin", F.round("surprise", 6).alias("surprise"), "fired", "winner", (F.col("fired") == F.col("winner")).alias("correct")).orderBy("origin", "series_id")


@query("backtest_lists", f"WITH {_EVENTS} SELECT series_id, origin, CASE WHEN fired AND winner THEN 'hit' WHEN fired THEN 'false alarm' WHEN winner THEN 'miss' ELSE 'rightly silent' END AS list, round(surprise, 6) AS surprise FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL")
def backtest_lists(spark, sf_dir):
    """Hits, false alarms, misses and rightly silent series, the strongest first."""
    f, w = F.col("fired"), F.col("winner")
    kind = F.when(f & w, "hit").when(f, "false alarm").when(w, "miss").otherwise("rightly silent")
    return _events(spark, sf_dir).filter(f.isNotNull() & w.isNotNull()).select("series_id", "origin", kind.alias("list"), F.round("surprise", 6).alias("surprise")).orderBy("list", F.desc("surprise"))


@query("concept_split", "SELECT p_brand AS concept, CASE ('0x' || substr(md5('v2|' || p_brand), 1, 8))::BIGINT % 3 WHEN 2 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS parts FROM part GROUP BY ALL")
def concept_split(spark, sf_dir):
    return domain.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("concept")).agg(F.count("*").alias("parts")).withColumn("split", bt.split_of(F.col("concept"), "v2"))


_FISHER = f"""WITH RECURSIVE {_EVENTS}, cf AS (SELECT origin, {_CONF} FROM ev WHERE fired IS NOT NULL AND winner IS NOT NULL GROUP BY ALL),
x AS (SELECT *, a + b + c + d AS n, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM cf),
t AS (SELECT origin, a, b, c, d, sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - (a + c - i) + 1) - (lgamma(n + 1) - lgamma(a + c + 1) - lgamma(n - a - c + 1)))) AS p
  FROM x WHERE a + c - i <= c + d GROUP BY ALL)
SELECT origin, round(CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1 ELSE least(1, p) END, 6) AS p_fisher, round(CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1 ELSE least(1, least(1, p) * 27) END, 6) AS p_deflated FROM t"""


@query("fisher_by_origin", _FISHER)
def fisher_by_origin(spark, sf_dir):
    cf = inf.confusion(_events(spark, sf_dir), ["origin"])
    p = inf.fisher_greater(*(F.col(x) for x in "abcd"))
    return cf.select("origin", F.round(p, 6).alias("p_fisher"), F.round(inf.deflate(p, F.lit(27)), 6).alias("p_deflated"))


@query("surrogate_significance")
def surrogate_significance(spark, sf_dir):
    """Monte-Carlo p of every live series that did not fail its audit, step-up control over all of them, and how many survivors are
    expected to be false; statistical, so it has no SQL."""
    from . import audit

    live = discovery.live_series(audit.meta(spark, sf_dir), audit.health(spark, sf_dir)).select("series_id")
    p = inf.empirical_p(domain.monthly(spark, sf_dir).join(live, "series_id", "left_semi"), ["series_id"])
    got = inf.benjamini_hochberg(p.filter("p_mc IS NOT NULL"), "p_mc")
    got = cut(got)
    return got.crossJoin(F.broadcast(got.agg((F.lit(0.10) * F.count_if("survive")).alias("expected_false"))))  # one row


@query("block_permutation")
def block_permutation(spark, sf_dir):
    blocks = cut(inf.block_counts(_events(spark, sf_dir), ["origin", "cohort"]))
    return inf.block_permutation(blocks).crossJoin(inf.block_bootstrap(blocks))  # one row each


@query("power_of_design")
def power_of_design(spark, sf_dir):
    return inf.power_curve(cut(inf.block_counts(_events(spark, sf_dir), ["origin", "cohort"])))
