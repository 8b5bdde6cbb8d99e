"""Persistence rungs, projections, thresholds and card gates as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ladder, scoring, series
from ..sources import domain
from .catalog import BRANDS, MONTHLY, med, query
from .rounds import phi_sql, quantile_sql

_FAILED = "hl AS (SELECT DISTINCT p_brand AS series_id FROM part WHERE p_brand LIKE 'Brand#2%')"
_RUNGS = f"""{BRANDS}, {_FAILED},
el AS (SELECT pts.* FROM pts WHERE series_id NOT IN (SELECT series_id FROM hl) AND series_id IN (SELECT series_id FROM pts GROUP BY ALL HAVING count(*) >= 10)),
s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x) - 1 AS i, lead(x, 2) OVER (PARTITION BY series_id ORDER BY x) AS resolves, lead(y, 2) OVER (PARTITION BY series_id ORDER BY x) AS later, ln(y / lag(y) OVER (PARTITION BY series_id ORDER BY x)) AS r, max(y) OVER (PARTITION BY series_id ORDER BY x) AS peak FROM el),
f AS (SELECT *, avg(r) OVER u AS mu, stddev_samp(r) OVER u AS sd, count(r) OVER u AS m, avg(r) OVER (PARTITION BY series_id ORDER BY x ROWS 2 PRECEDING) AS recent FROM s WINDOW u AS (PARTITION BY series_id ORDER BY x)),
rungs AS (SELECT series_id, i, x AS origin, resolves, y AS threshold, mu AS drift, greatest(1e-6::DOUBLE, sd) AS vol, r AS last, recent - mu AS accel, (y - peak) / peak AS drawdown, greatest(0.02::DOUBLE, sd) AS sigma, m AS n_rets, CASE WHEN later >= y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM f WHERE i >= 6 AND later IS NOT NULL AND m >= 3)"""


def rungs(spark, sf_dir):
    failed = domain.table(spark, sf_dir, "part").filter(F.col("p_brand").startswith("Brand#2")).select(F.col("p_brand").alias("series_id"), F.lit("fail").alias("status")).distinct()
    return ladder.candidates(ladder.eligible(domain.monthly(spark, sf_dir, fine=False), failed))


@query("ladder_rungs", f"WITH {_RUNGS} SELECT series_id, i::INT AS i, origin, resolves, threshold, round(drift, 6) + 0.0::DOUBLE AS drift, round(vol, 6) AS vol, round(last, 6) + 0.0::DOUBLE AS last, round(accel, 6) + 0.0::DOUBLE AS accel, round(drawdown, 6) + 0.0::DOUBLE AS drawdown, round(sigma, 6) AS sigma, n_rets::INT AS n_rets, y FROM rungs")
def ladder_rungs(spark, sf_dir):
    """Every rung of the series that are eligible: features of the history up to the origin, and whether the level held."""
    return rungs(spark, sf_dir).drop("mu").withColumns({c: F.round(c, 6) + 0.0 for c in ("drift", "vol", "last", "accel", "drawdown", "sigma")})


@query("ladder_base_rates", f"WITH {_RUNGS}, o AS (SELECT DISTINCT origin FROM rungs) SELECT origin, (SELECT count(*) FROM rungs WHERE resolves <= o.origin) AS n_known, round(coalesce((SELECT avg(y) FROM rungs WHERE resolves <= o.origin), 0.5), 9) AS base FROM o")
def ladder_base_rates(spark, sf_dir):
    """The outcome rate of what had resolved by each origin."""
    return ladder.expanding_base_rate(rungs(spark, sf_dir)).withColumn("base", F.round("base", 9))


_HOLD = f"round({phi_sql('(drift * sqrt(2.0::DOUBLE) / sigma)')}, 6)"


@query("ladder_closed_form", f"WITH {_RUNGS} SELECT series_id, i::INT AS i, {_HOLD} AS p_hold FROM rungs")
def ladder_closed_form(spark, sf_dir):
    return rungs(spark, sf_dir).select("series_id", "i", F.round(ladder.hold_p(F.col("mu"), F.col("sigma"), F.lit(2.0)), 6).alias("p_hold"))


_SCORED = f"{_RUNGS}, p AS (SELECT origin, {_HOLD} AS p, y FROM rungs)"


@query("ladder_board", f"WITH {_SCORED}, c AS (SELECT *, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) AS q FROM p) SELECT count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, 0.25::DOUBLE AS brier_half, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS hit_rate, round(avg(y), 6) AS base_rate FROM c")
def ladder_board(spark, sf_dir):
    """The rungs' score under the closed form."""
    p = rungs(spark, sf_dir).select(F.round(ladder.hold_p(F.col("mu"), F.col("sigma"), F.lit(2.0)), 6).alias("p"), F.col("y").cast("int").alias("outcome"))
    return scoring.calibration(p).withColumns({c: F.round(c, 6) for c in ("brier", "brier_half", "log_loss", "hit_rate", "base_rate")})


@query("ladder_newest_board", f"WITH {_RUNGS} SELECT series_id, i::INT AS i, origin, threshold FROM rungs ORDER BY origin DESC, series_id LIMIT 200")
def ladder_newest_board(spark, sf_dir):
    return rungs(spark, sf_dir).select("series_id", "i", "origin", "threshold").orderBy(F.desc("origin"), "series_id").limit(200)


@query("ladder_prices")
def ladder_prices(spark, sf_dir):
    """Each rung's price from the model fitted on what had resolved by its origin (gradient descent, so no SQL)."""
    return ladder.price(rungs(spark, sf_dir)).select("series_id", "i", "origin", F.round("price", 6).alias("price"), "y")


_TWO_PASS = f"""WITH {_RUNGS}, o AS (SELECT DISTINCT origin FROM rungs),
b AS (SELECT origin, coalesce((SELECT avg(y) FROM rungs WHERE resolves <= o.origin), 0.5) AS p FROM o),
z AS (SELECT *, sigma * sqrt(2.0::DOUBLE) AS wide, {quantile_sql("(1 - p)")} AS z FROM rungs JOIN b USING (origin)),
m AS (SELECT *, threshold - threshold * exp(drift * 2 + z * wide) AS shift FROM z),
en AS (SELECT series_id, max(x) AS last_x FROM pts GROUP BY ALL),
sn AS (SELECT series_id, i, max(pts.x) AS seen_x, arg_max(pts.y, pts.x) AS seen_y FROM m JOIN pts USING (series_id) WHERE pts.x <= m.origin + 24 GROUP BY ALL)
SELECT series_id, i::INT AS i, origin, origin + 24 AS due, p::FLOAT::DOUBLE AS price, (threshold * exp(drift * 2 - 1.2815515655446004::DOUBLE * wide) + shift)::FLOAT::DOUBLE AS low, (threshold * exp(drift * 2) + shift)::FLOAT::DOUBLE AS median, (threshold * exp(drift * 2 + 1.2815515655446004::DOUBLE * wide) + shift)::FLOAT::DOUBLE AS high,
  y AS label, CASE WHEN last_x >= origin + 24 THEN seen_x END AS seen_x, CASE WHEN last_x >= origin + 24 THEN (seen_y >= threshold)::INT END AS outcome
FROM m JOIN en USING (series_id) JOIN sn USING (series_id, i)"""


@query("ladder_two_pass", _TWO_PASS)
def ladder_two_pass(spark, sf_dir):
    """Every rung priced by what had resolved by its origin (the base rate), issued with an interval that fits the price, and resolved by
    the calendar, two years on: another date than the label's, two observations on."""
    priced = ladder.issued(ladder.price(rungs(spark, sf_dir), min_train=1 << 40))
    got = ladder.resolved(priced, domain.monthly(spark, sf_dir, fine=False), 24.0)
    short = lambda c: F.col(c).cast("float").cast("double").alias(c)
    return got.select("series_id", "i", "origin", "due", short("price"), short("low"), short("median"), short("high"), F.col("y").alias("label"), "seen_x", "outcome")


@query("ladder_projection")
def ladder_projection(spark, sf_dir):
    """Projection of each rung with honest tails (Monte Carlo, so no SQL)."""
    return ladder.project(rungs(spark, sf_dir)).select("series_id", "i", "p_hold", "median", "low", "high")


_SAMPLES = f"""WITH {MONTHLY}, s AS (SELECT series_id, list_sort(list(y)) AS v, count(*) AS n FROM pts GROUP BY ALL),
g AS (SELECT series_id, v, n, list_transform(range(0, 1001), lambda k: v[round_even(k / 1000.0::DOUBLE * (n - 1), 0)::INT + 1]) AS g FROM s)"""


@query("card_tilts", f"""{_SAMPLES}, t AS (SELECT *, g[round_even(0.3::DOUBLE * 1000, 0)::INT + 1] AS q, {med("v")} * 1.05::DOUBLE AS thr FROM g)
SELECT series_id, g[101] AS low, g[501] AS median, g[901] AS high, round(thr - q, 6) AS shift, round(len(list_filter(v, lambda x: x >= thr)) / n, 9) AS p_before FROM t""")
def card_tilts(spark, sf_dir):
    """The shift of each series' distribution that gives a level 5 % above its median a probability of 0.7."""
    g = series.gather(domain.monthly(spark, sf_dir), ["series_id"]).select("series_id", F.sort_array(F.transform("pts", lambda p: p["y"])).alias("v"))
    g = g.withColumn("g", ladder.quantile_grid(F.col("v"))).withColumn("thr", series.median_of(F.col("v")) * 1.05)
    at = lambda p: ladder.grid_quantile(F.col("g"), F.lit(p))
    yes = F.lit(True)
    return g.select("series_id", at(0.1).alias("low"), at(0.5).alias("median"), at(0.9).alias("high"), F.round(ladder.tilt(F.col("g"), F.lit(0.7), F.col("thr"), yes), 6).alias("shift"), F.round(ladder.beyond_p(F.col("v"), F.col("thr"), yes), 9).alias("p_before"))


@query("crossing_forecasts", f"""WITH {MONTHLY}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n, y - lag(y) OVER (PARTITION BY series_id ORDER BY x) AS d FROM pts),
a AS (SELECT series_id, avg(d) AS mu, stddev_pop(d) AS sd FROM o WHERE back <= 11 AND n >= 3 GROUP BY ALL), l AS (SELECT series_id, x, y FROM o WHERE back = 1),
z AS (SELECT series_id, y + (24060 - x) * mu AS mid, greatest(1e-9::DOUBLE, sd * sqrt(24060 - x)) AS wide, y * 0.9::DOUBLE AS level FROM a JOIN l USING (series_id) WHERE 24060 > x),
f AS (SELECT *, (level - mid) / wide AS z FROM z), p AS (SELECT *, round({phi_sql('z')}, 6) AS p FROM f)
SELECT series_id, p, round(mid, 6) AS median, round(mid - 1.2815515655446004::DOUBLE * wide, 6) AS low, round(mid + 1.2815515655446004::DOUBLE * wide, 6) AS high FROM p WHERE p > 0.05 AND p < 0.99""")
def crossing_forecasts(spark, sf_dir):
    """Will the series fall below 90 % of its last level by the end of 2004 (month 24060)? Near-certain ones are left out."""
    pts = domain.monthly(spark, sf_dir)
    got = ladder.crossing_p(pts, F.lit(24060.0), F.element_at("pts", -1)["y"] * 0.9, F.lit(True)).withColumns({c: F.round(c, 6) for c in ("p", "median", "low", "high")})
    return got.filter("p > 0.05 AND p < 0.99")


@query("refused_cards", r"""WITH c AS (SELECT o_orderkey AS card_id, CASE o_orderkey % 5 WHEN 0 THEN 'Will Acme (ACME) revenue exceed 5?' WHEN 1 THEN 'Is the share price up?' WHEN 2 THEN 'Will (ACME) end the short supply?' WHEN 3 THEN 'Acme (AC) EPS over 1?' ELSE 'Does supply hold?' END AS question, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE 'good' END AS seed,
  10.0::DOUBLE AS low, 20.0::DOUBLE AS high, 5.0::DOUBLE + o_orderkey % 21 AS threshold, (o_orderkey % 10) / 10.0::DOUBLE AS p, o_orderkey % 2 = 0 AS rising FROM orders),
w AS (SELECT card_id, CASE WHEN regexp_matches(question, '\([A-Z]{2,5}\)') AND regexp_matches(question, '(?i)\b(revenue|EPS|share price)\b') THEN 'instrument' WHEN seed = 'bad' THEN 'seed failed its audit'
  WHEN CASE WHEN rising THEN threshold < low - 0.200000001 ELSE threshold > high + 0.200000001 END AND p < 0.90::DOUBLE - 0.05::DOUBLE THEN 'probability against interval'
  WHEN CASE WHEN rising THEN threshold > high + 0.200000001 ELSE threshold < low - 0.200000001 END AND p > 0.10::DOUBLE + 0.05::DOUBLE THEN 'probability against interval' END AS why FROM c)
SELECT card_id, why FROM w WHERE why IS NOT NULL""")
def refused_cards(spark, sf_dir):
    """Cards at one company's figures, on a failed series, or at odds with themselves."""
    i = F.col("o_orderkey")
    asked = {0: "Will Acme (ACME) revenue exceed 5?", 1: "Is the share price up?", 2: "Will (ACME) end the short supply?", 3: "Acme (AC) EPS over 1?"}
    q = F.lit("Does supply hold?")
    for k, text in asked.items():
        q = F.when(i % 5 == k, text).otherwise(q)
    cards = domain.table(spark, sf_dir, "orders").select(i.alias("card_id"), q.alias("question"), F.when(i % 9 == 0, "bad").otherwise("good").alias("seed"), F.lit(10.0).alias("low"), F.lit(20.0).alias("high"), (F.lit(5.0) + i % 21).alias("threshold"), (i % 10 / F.lit(10.0)).alias("p"), (i % 2 == 0).alias("rising"))
    return ladder.refused_cards(cards, spark.createDataFrame([("bad", "fail")], "series_id string, status string"))


@query("slow_constraints_board", f"""WITH {MONTHLY}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY x DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
c AS (SELECT series_id, y AS current FROM o WHERE back = 1 AND n >= 8), sl AS (SELECT a.series_id, list((b.y - a.y) / (b.x - a.x)) AS s FROM o a JOIN o b USING (series_id) WHERE a.back <= 12 AND b.back < a.back GROUP BY ALL),
v AS (SELECT series_id, current, {med("s")} AS slope FROM c JOIN sl USING (series_id)),
w AS (SELECT series_id, current, slope, current <= 100 AS crossed, CASE WHEN slope < 0 AND current > 100 THEN (current - 100) / (-slope) END AS ytc FROM v)
SELECT series_id, current, round(slope, 6) AS slope, crossed, round(ytc, 6) AS years_to_cross, CASE WHEN crossed THEN 'binding' WHEN ytc <= 10 THEN 'crossing_soon' WHEN ytc <= 30 THEN 'approaching' ELSE 'stable' END AS status, CASE WHEN series_id LIKE 'Brand#2%' THEN 'fail' END AS qc_status FROM w""")
def slow_constraints_board(spark, sf_dir):
    """Series that sink to a level of 100: crossed first, then the soonest (those that never cross come first of the rest)."""
    pts = domain.monthly(spark, sf_dir)
    got = series.detect_threshold(pts, ["series_id"], F.lit(100.0), "falling").withColumns({c: F.round(c, 6) for c in ("slope", "years_to_cross")})
    health = pts.filter(F.col("series_id").startswith("Brand#2")).select("series_id", F.lit("fail").alias("qc_status")).distinct()
    return got.join(health, "series_id", "left").orderBy(F.desc("crossed"), F.asc_nulls_first("years_to_cross"), "series_id")
