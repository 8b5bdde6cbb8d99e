"""Frozen cases, recall probes, the locator and the experiment ledger as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as ex
from ..sources import domain
from .catalog import BRANDS, detect_sql, query

_LOG = "SELECT * REPLACE (ln(greatest(y, 0.5::DOUBLE)) AS y)"
_CASES = f"""{BRANDS}, cs AS (SELECT DISTINCT p_brand AS series_id, CASE WHEN substr(p_brand, 7)::INT % 2 = 0 THEN 'winner' ELSE 'fizzle' END AS category, 1999 * 12 + 12 AS signal, CASE WHEN substr(p_brand, 7)::INT % 3 = 0 THEN 2001 * 12 END AS consensus, substr(p_brand, 7)::INT % 5 <> 0 AS capturable FROM part),
kn AS ({_LOG} FROM pts WHERE x <= 1999 * 12 + 12), {detect_sql('kn', k=1.5)},
rt0 AS (SELECT cs.*, CASE WHEN NOT capturable THEN 'not_capturable' WHEN surprise IS NULL THEN 'insufficient_data' WHEN fired THEN 'fired' ELSE 'silent' END AS verdict, surprise AS sigma, (category = 'winner')::INT AS outcome FROM cs LEFT JOIN det USING (series_id)),
rt AS (SELECT *, round_even(1 / (1 + exp(-(CASE WHEN verdict IN ('fired', 'silent') THEN sigma ELSE 0 END - 1.5))), 3) AS p, (verdict = 'fired') = (outcome = 1) AS correct, CASE WHEN verdict = 'fired' AND outcome = 1 AND consensus IS NOT NULL THEN greatest(0, (consensus - signal) * 12) END AS lead_months FROM rt0)"""


def _retro(spark, sf_dir):
    pts = domain.monthly(spark, sf_dir, fine=False).withColumnRenamed("series_id", "case")
    n = F.substring("case", 7, 9).cast("int")
    cases = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("case")).distinct()
    cases = cases.select("case", F.when(n % 2 == 0, "winner").otherwise("fizzle").alias("category"), F.lit(1999 * 12 + 12).alias("signal"), F.when(n % 3 == 0, 2001 * 12).alias("consensus"), (n % 5 != 0).alias("capturable"))
    return ex.retro(cases, pts, 1.5)


@query("retro_cases_board", f"WITH {_CASES} SELECT series_id AS case, category, verdict, round(sigma, 6) AS sigma, p, outcome, correct, lead_months FROM rt")
def retro_cases_board(spark, sf_dir):
    """Frozen cases under the frozen rule."""
    return _retro(spark, sf_dir).drop("sustained").withColumn("sigma", F.round("sigma", 6)).orderBy("category", F.desc("outcome"), "case")


_LL = "-(CASE WHEN {y} THEN ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {p}))) ELSE ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {p}))) END)"


@query("retro_score_board", f"""WITH {_CASES}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 1) AS w, count(*) FILTER (WHERE verdict = 'fired') AS f, count(*) FILTER (WHERE verdict = 'fired' AND outcome = 1) AS tp, count(*) FILTER (WHERE verdict <> 'fired' AND outcome = 0) AS tn,
  list_sort(list(lead_months) FILTER (WHERE lead_months IS NOT NULL)) AS leads, avg(pow(p - outcome, 2)) AS brier, avg({_LL.format(y='outcome = 1', p='p')}) AS ll FROM rt),
b AS (SELECT *, w / n AS base, CASE WHEN f > 0 THEN tp / f ELSE 0 END AS prec FROM a)
SELECT n, round(base, 6) AS base_rate, round(prec, 6) AS precision, round(CASE WHEN w > 0 THEN tp / w ELSE 0 END, 6) AS recall, round(CASE WHEN n > w THEN tn / (n - w) ELSE 0 END, 6) AS specificity, round(CASE WHEN base > 0 THEN prec / base ELSE 0 END, 6) AS lift,
  leads[len(leads) // 2 + 1] AS median_lead, round(brier, 6) AS brier, round(base * (1 - base), 6) AS brier_base, round(ll, 6) AS log_loss, round(-(base * ln(base) + (1 - base) * ln(1 - base)), 6) AS log_loss_base FROM b""")
def retro_score_board(spark, sf_dir):
    got = ex.retro_score(_retro(spark, sf_dir))
    return got.withColumns({c: F.round(c, 6) for c in ("base_rate", "precision", "recall", "specificity", "lift", "brier", "brier_base", "log_loss", "log_loss_base")})


_CUTS = (1997, 1998, 1999, 2000)


@query("recall_probe_board", f"""WITH {BRANDS}, co AS (SELECT unnest({[c * 12 + 12 for c in _CUTS]}) AS cutoff), kn AS (SELECT series_id, cutoff, x, ln(greatest(y, 0.5::DOUBLE)) AS y FROM pts, co WHERE x <= cutoff), {detect_sql('kn', 'series_id, cutoff', 1.5)},
pb AS (SELECT DISTINCT p_brand AS series_id, CASE substr(p_brand, 7)::INT % 3 WHEN 0 THEN 'winner' WHEN 1 THEN 'fizzle' ELSE 'commercial_fizzle' END AS kind, 1999 * 12 + 12 AS signal FROM part),
f AS (SELECT series_id, min(cutoff) AS first_fire, arg_min(round_even(surprise, 2), cutoff) AS first_sigma FROM det WHERE fired GROUP BY ALL)
SELECT series_id, kind, first_fire, first_sigma, CASE WHEN kind = 'winner' AND first_fire < signal THEN signal - first_fire END AS lead_years,
  CASE kind WHEN 'winner' THEN CASE WHEN first_fire < signal THEN 'recall_gain' ELSE 'no_gain' END WHEN 'commercial_fizzle' THEN CASE WHEN first_fire IS NOT NULL THEN 'research_fired' ELSE 'silent' END ELSE CASE WHEN first_fire IS NOT NULL THEN 'false_positive' ELSE 'silent_correct' END END AS verdict FROM pb LEFT JOIN f USING (series_id)""")
def recall_probe_board(spark, sf_dir):
    """When would each probe have fired first, had one looked at earlier cutoffs (here in months)?"""
    n = F.substring("series_id", 7, 9).cast("int") % 3
    probes = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("series_id")).distinct()
    probes = probes.select("series_id", F.when(n == 0, "winner").when(n == 1, "fizzle").otherwise("commercial_fizzle").alias("kind"), F.lit(1999 * 12 + 12).alias("signal"))
    got = ex.recall_probe(probes, domain.monthly(spark, sf_dir, fine=False), [c * 12 + 12 for c in _CUTS], 1.5).drop("trace")
    return got.orderBy(F.when(F.col("kind") == "winner", 0).when(F.col("kind") == "fizzle", 1).otherwise(2), "series_id")


_LAYERS = """px AS (SELECT p_type AS layer, (year(l_shipdate) * 12 + month(l_shipdate))::DOUBLE AS x, year(l_shipdate) AS year, avg(l_extendedprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
oo AS (SELECT unnest([1997, 1998, 1999]) AS origin),
kn AS (SELECT layer, origin, x, ln(greatest(y, 0.5::DOUBLE)) AS y FROM px, oo WHERE year <= origin)"""
_LOCATE = f"""{_LAYERS}, {detect_sql('kn', 'layer, origin')},
q AS (SELECT a.layer, a.origin, list((b.y - a.y) / (b.x - a.x)) AS s, count(DISTINCT a.x) + 1 AS n FROM kn a JOIN kn b ON b.layer = a.layer AND b.origin = a.origin AND b.x > a.x GROUP BY ALL),
qs AS (SELECT layer, origin, (list_sort(s)[(len(s) + 1) // 2] + list_sort(s)[len(s) // 2 + 1]) / 2 AS slope FROM q WHERE n >= 5),
rs AS (SELECT layer, origin, ln(avg(y) FILTER (WHERE year > origin AND year <= origin + 4) / arg_max(y, x) FILTER (WHERE year <= origin)) AS rise FROM px, oo GROUP BY ALL),
cd AS (SELECT layer, origin, coalesce(surprise, qs.slope) AS score, qs.slope AS slope, rise FROM qs JOIN rs USING (layer, origin) LEFT JOIN det USING (layer, origin) WHERE rise IS NOT NULL),
lo AS (SELECT origin, count(*) AS n_layers, arg_max(layer, score) AS located, arg_max(layer, slope) AS obvious, arg_max(layer, rise) AS winner, max(rise) AS rise FROM cd GROUP BY ALL HAVING count(*) >= 2)"""


def _located(spark, sf_dir):
    part = domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("layer"))
    i = domain.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    px = i.groupBy("layer", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("double").alias("x"), F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("y"))
    return ex.locate(px, [1997, 1998, 1999])


@query("locator_cases", f"WITH {_LOCATE} SELECT origin, n_layers, located, obvious, winner, round(exp(rise), 6) AS multiple, located = winner AS hit, obvious = winner AS obvious_hit FROM lo")
def locator_cases(spark, sf_dir):
    """Which layer binds next, by prices up to each origin, and which one's price rose most after it?"""
    return _located(spark, sf_dir).withColumn("multiple", F.round("multiple", 6))


@query("locator_hit_rates", f"WITH {_LOCATE} SELECT count(*) AS n, round(avg((located = winner)::INT), 6) AS hit_rate, round(avg((obvious = winner)::INT), 6) AS obvious_rate, round(avg(1 / n_layers), 6) AS chance FROM lo")
def locator_hit_rates(spark, sf_dir):
    return ex.hit_rates(_located(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("hit_rate", "obvious_rate", "chance")})


# A ledger of runs: orders are runs, their priority the configuration.
_LEDGER = """led AS (SELECT (o_custkey % 3 + 1)::INT AS protocol, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'select' END AS split, o_orderpriority AS config, (o_orderkey % 50)::INT AS n_scored, round(o_totalprice / 100000.0::DOUBLE, 6) AS lift, (o_orderkey % 100) / 1000.0::DOUBLE AS p_block, substr(o_orderpriority, 1, 1)::DOUBLE AS k, o_orderkey AS seq FROM orders),
lst AS (SELECT protocol, split, config, arg_max(n_scored, seq) AS n_scored, arg_max(lift, seq) AS lift, arg_max(p_block, seq) AS p_block, any_value(k) AS k, max(seq) AS seq FROM led GROUP BY ALL),
sn AS (SELECT protocol, greatest(count(DISTINCT config), 27) AS n_seen FROM led GROUP BY ALL)"""


def _ledger(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = domain.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3 + 1).cast("int").alias("protocol"), F.when(i % 10 == 0, "test").otherwise("select").alias("split"), F.col("o_orderpriority").alias("config"), (i % 50).cast("int").alias("n_scored"), F.round(F.col("o_totalprice") / 100000.0, 6).alias("lift"), (i % 100 / F.lit(1000.0)).alias("p_block"), F.substring("o_orderpriority", 1, 1).cast("double").alias("k"), i.alias("at"))
    return rows, ex.ledger(rows)


@query("experiment_ledger", f"WITH {_LEDGER} SELECT protocol, split, config, n_scored, lift, p_block, n_seen, CASE WHEN split = 'test' THEN least(1.0::DOUBLE, p_block * n_seen) END AS p_deflated FROM lst JOIN sn USING (protocol)")
def experiment_ledger(spark, sf_dir):
    """A re-run overwrites its row; p is deflated on reveals only, by all configurations seen."""
    return _ledger(spark, sf_dir)[1].select("protocol", "split", "config", "n_scored", "lift", "p_block", "n_seen", "p_deflated")


@query("experiment_promotion", f"WITH {_LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY coalesce(lift, 0) DESC, k DESC, config DESC) AS rn FROM lst WHERE split = 'select' AND n_scored > 0) SELECT protocol, config, k, lift FROM r WHERE rn = 1")
def experiment_promotion(spark, sf_dir):
    return ex.promoted(_ledger(spark, sf_dir)[1])


@query("configurations_seen", f"WITH {_LEDGER} SELECT count(DISTINCT protocol || '|' || config) AS n FROM led")
def configurations_seen(spark, sf_dir):
    return ex.configurations_seen(_ledger(spark, sf_dir)[0])
