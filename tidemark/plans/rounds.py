"""Benchmark questions: models, combinations, gap policy and scores as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import _ERFC
from ..operators import benchmark as bm
from ..sources import domain
from .catalog import RATED, query


def phi_sql(z: str) -> str:
    """DuckDB: the distribution function of the standard normal, by the same approximation of erfc."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = f"{_ERFC[-1]}::DOUBLE"
    for c in reversed(_ERFC[:-1]):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    tail = f"(0.5::DOUBLE * {t} * exp(-({z}) * ({z}) / 2 + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def quantile_sql(p: str) -> str:
    """DuckDB: the inverse of the standard normal distribution function, by the same approximation."""
    poly = lambda cs, x: " + ".join(f"({c}::DOUBLE) * pow({x}, {len(cs) - 1 - k})" if k < len(cs) - 1 else f"({c}::DOUBLE)" for k, c in enumerate(cs))
    q = f"greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {p}))"
    tail = lambda t: f"(({poly(stats._C, f'sqrt(-2 * ln({t}))')}) / ({poly((*stats._D, 1.0), f'sqrt(-2 * ln({t}))')}))"
    r = f"({q} - 0.5::DOUBLE)"
    middle = f"(({poly(stats._A, f'({r} * {r})')}) * {r} / ({poly((*stats._B, 1.0), f'({r} * {r})')}))"
    return f"(CASE WHEN {q} < 0.02425 THEN {tail(q)} WHEN {q} > 1 - 0.02425 THEN -{tail(f'(1 - {q})')} ELSE {middle} END)"


DUE, RESOLVES = "1999-12-31", ("2000-02-28", "2000-09-30")
_QUOTES = f"""quotes AS (SELECT p_brand AS series_id, l_shipdate::DATE AS d, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
qs AS (SELECT DISTINCT series_id || '|' || r AS question, series_id, DATE '{DUE}' AS due, r::DATE AS resolves FROM quotes, (SELECT unnest(['{RESOLVES[0]}', '{RESOLVES[1]}']) AS r)),
o AS (SELECT question, due, resolves, d, v, row_number() OVER (PARTITION BY question ORDER BY d) AS rn, count(*) OVER (PARTITION BY question) AS n FROM qs JOIN quotes USING (series_id) WHERE d <= due),
mv AS (SELECT *, lead(v) OVER w AS nv, date_diff('day', d, lead(d) OVER w) AS gap FROM o WINDOW w AS (PARTITION BY question ORDER BY d)),
sp AS (SELECT question, greatest(1, floor(median(gap)))::INT AS period FROM mv WHERE gap > 0 GROUP BY ALL)"""


def quotes(spark, sf_dir):
    """series_id, d, v: a brand's daily quantity."""
    part = domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    items = domain.table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_quantity").groupBy("l_partkey", "d").agg(F.sum("l_quantity").alias("q"))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("series_id", "d").agg(F.sum("q").alias("v"))


def questions(spark, sf_dir):
    names = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("series_id")).distinct()
    r = F.explode(F.array(*map(F.lit, RESOLVES)))
    return names.select("series_id", r.alias("r")).select(F.concat_ws("|", "series_id", "r").alias("question"), "series_id", F.lit(DUE).cast("date").alias("due"), F.col("r").cast("date").alias("resolves"))


def _modelled(spark, sf_dir, p):
    h = bm.histories(quotes(spark, sf_dir), questions(spark, sf_dir))
    return h.select("question", F.round(p, 6).alias("p"))


_DRIFT = f"""WITH {_QUOTES}, a AS (SELECT question, n, date_diff('day', due, resolves) AS h, avg(nv - v) AS mu, stddev_pop(nv - v) AS sd, count(nv) AS m FROM mv GROUP BY ALL),
b AS (SELECT question, n, h, mu, CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS sd, m FROM a), t AS (SELECT *, mu / (sd / sqrt(m)) AS t FROM b),
z AS (SELECT question, n, mu * t * t / (t * t + 1) / sd * sqrt(h / period) AS z FROM t JOIN sp USING (question))
SELECT question, round(CASE WHEN n >= 30 THEN {phi_sql('z')} END, 6) AS p FROM qs LEFT JOIN z USING (question)"""


@query("question_drift", _DRIFT)
def question_drift(spark, sf_dir):
    return _modelled(spark, sf_dir, bm.drift_p())


@query("question_equity", f"""WITH {_QUOTES}, a AS (SELECT question, n, date_diff('day', due, resolves) * 252 / 365.0::DOUBLE AS days, stddev_pop(ln(nv / v)) AS sd, count(nv) AS m FROM mv GROUP BY ALL),
z AS (SELECT question, n, m, 0.0003::DOUBLE * sqrt(days) / CASE WHEN sd > 0 THEN sd ELSE 1e-9 END AS z FROM a)
SELECT question, round(CASE WHEN n >= 60 AND m >= 30 THEN {phi_sql('z')} END, 6) AS p FROM qs LEFT JOIN z USING (question)""")
def question_equity(spark, sf_dir):
    return _modelled(spark, sf_dir, bm.equity_p())


@query("question_base_rate", f"""WITH {_QUOTES}, st AS (SELECT question, greatest(1, round_even(date_diff('day', due, resolves) / period, 0))::INT AS step FROM qs JOIN sp USING (question)),
w AS (SELECT a.question, b.v > a.v AS up, pow(0.5::DOUBLE, date_diff('day', b.d, b.due) / 365.25::DOUBLE / 5) AS w FROM o a JOIN st USING (question) JOIN o b ON b.question = a.question AND b.rn = a.rn + step WHERE a.n >= 8),
r AS (SELECT question, sum(w) AS tot, coalesce(sum(w) FILTER (WHERE up), 0) AS ups FROM w GROUP BY ALL)
SELECT question, round(CASE WHEN tot >= 3 THEN greatest(0.03::DOUBLE, least(0.97::DOUBLE, ups / tot)) END, 6) AS p FROM qs LEFT JOIN r USING (question)""")
def question_base_rate(spark, sf_dir):
    return _modelled(spark, sf_dir, bm.base_rate_p())


@query("question_seasonal", f"""WITH {_QUOTES}, nw AS (SELECT question, arg_max(v, d) AS now, count(*) AS n FROM o GROUP BY ALL),
pl AS (SELECT question, v FROM o WHERE least(abs(dayofyear(d) - dayofyear(resolves)), 366 - abs(dayofyear(d) - dayofyear(resolves))) <= 12)
SELECT question, round(CASE WHEN any_value(n) >= 365 AND count(*) >= 15 THEN (count(*) FILTER (WHERE v > now) + 1) / (count(*) + 2) END, 6) AS p FROM pl JOIN nw USING (question) GROUP BY question""")
def question_seasonal(spark, sf_dir):
    return bm.seasonal(quotes(spark, sf_dir), questions(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query("question_routing", f"""WITH {_QUOTES}, a AS (SELECT question, CASE series_id WHEN 'Brand#1' THEN 'wikipedia' WHEN 'Brand#2' THEN 'acled' ELSE 'none' END AS source, date_diff('day', due, resolves) AS h FROM qs)
SELECT question, source, CASE source WHEN 'wikipedia' THEN CASE WHEN h <= 550 THEN 0.96::DOUBLE ELSE 0.85::DOUBLE END WHEN 'acled' THEN 0.14::DOUBLE ELSE 0.5::DOUBLE END AS p FROM a""")
def question_routing(spark, sf_dir):
    """Questions go to the model of their source; without one they are one half."""
    q = questions(spark, sf_dir)
    source = F.when(F.col("series_id") == "Brand#1", "wikipedia").when(F.col("series_id") == "Brand#2", "acled").otherwise("none")
    priors = q.select("question", bm.prior_p(F.lit("Will the world record still stand?"), F.datediff("resolves", "due")).alias("p"))
    conflict = q.select("question", bm.conflict_prior(F.lit(2.0)).alias("p"))
    return bm.routed(q.select("question", source.alias("source")), ("wikipedia", priors), ("acled", conflict))


@query("sign_correlations", f"""WITH {_QUOTES}, l AS (SELECT series_id, d, lead(d, 30) OVER w AS e, (lead(v, 30) OVER w > v)::INT AS up FROM quotes WINDOW w AS (PARTITION BY series_id ORDER BY d)),
m AS (SELECT x.series_id AS a, y.series_id AS b, x.up AS ua, y.up AS ub FROM l x JOIN l y ON x.d = y.d WHERE x.series_id = 'Brand#1' AND y.series_id <> 'Brand#1' AND x.e <= DATE '{DUE}' AND y.e <= DATE '{DUE}'),
c AS (SELECT a, b, count(*)::DOUBLE AS n, sum(ua * ub) * count(*)::DOUBLE - sum(ua) * sum(ub)::DOUBLE AS cov, sum(ua) * count(*)::DOUBLE - pow(sum(ua), 2) AS va, sum(ub) * count(*)::DOUBLE - pow(sum(ub), 2) AS vb FROM m GROUP BY ALL),
pr AS (SELECT DISTINCT 'Brand#1' AS a, p_brand AS b FROM part WHERE p_brand <> 'Brand#1')
SELECT a, b, round(coalesce(CASE WHEN n >= 20 AND va > 0 AND vb > 0 THEN greatest(-0.9::DOUBLE, least(0.9::DOUBLE, cov / sqrt(va * vb))) * n / (n + 30) END, 0), 6) AS rho FROM pr LEFT JOIN c USING (a, b)""")
def sign_correlations(spark, sf_dir):
    """How the signs of 30-step moves of one brand and every other go together, shrunk by how many dates they share."""
    names = domain.table(spark, sf_dir, "part").select(F.col("p_brand").alias("b")).distinct().filter("b <> 'Brand#1'")
    pairs = names.select(F.lit("Brand#1").alias("a"), "b", F.lit(DUE).cast("date").alias("due"))
    return bm.sign_correlation(quotes(spark, sf_dir), pairs, 30).select("a", "b", F.round("rho", 6).alias("rho"))


@query("combination_forecasts")
def combination_forecasts(spark, sf_dir):
    """Four joint probabilities of each pair of brands' questions, by a Gaussian copula (no SQL: a bivariate normal integral)."""
    q = questions(spark, sf_dir).filter(F.col("resolves") == RESOLVES[0])
    p = bm.histories(quotes(spark, sf_dir), q).select("series_id", bm.base_rate_p().alias("p"))
    pairs = sign_correlations(spark, sf_dir).join(p.toDF("a", "p1"), "a").join(p.toDF("b", "p2"), "b")
    return bm.combos(pairs.filter("p1 IS NOT NULL AND p2 IS NOT NULL"))


# Rounds: labelled documents are questions; even ids are markets, the rest of datasets.
_ROUND = f"""{RATED},
res AS (SELECT doc_id AS question, source, doc_id % 2 = 0 AS market, DATE '2024-01-01' + (doc_id % 3)::INT AS resolves, CASE WHEN doc_id % 4 = 0 THEN '1,1' END AS direction, outcome, (doc_id % 3)::INT AS round FROM rated),
fc AS (SELECT doc_id AS question, CASE WHEN doc_id % 4 = 0 THEN '1,1' END AS direction, DATE '2024-01-01' + (doc_id % 3)::INT + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS resolves, p FROM rated WHERE doc_id % 5 <> 0),
sc AS (SELECT res.*, coalesce(fc.p, 0.5::DOUBLE) AS p, fc.p IS NULL AS missing, pow(coalesce(fc.p, 0.5::DOUBLE) - outcome, 2) AS brier FROM res LEFT JOIN fc ON fc.question = res.question AND fc.direction IS NOT DISTINCT FROM res.direction AND (market OR fc.resolves = res.resolves))"""


def resolutions(spark, sf_dir):
    i = F.col("doc_id")
    when = F.date_add(F.lit("2024-01-01").cast("date"), (i % 3).cast("int"))
    return domain.rated(spark, sf_dir).select(i.alias("question"), "source", (i % 2 == 0).alias("market"), when.alias("resolves"), F.when(i % 4 == 0, "1,1").alias("direction"), "outcome", (i % 3).cast("int").alias("round"))


def forecasts(spark, sf_dir):
    i = F.col("doc_id")
    when = F.date_add(F.lit("2024-01-01").cast("date"), (i % 3 + F.when(i % 7 == 0, 1).otherwise(0)).cast("int"))
    return domain.rated(spark, sf_dir).filter(i % 5 != 0).select(i.alias("question"), F.when(i % 4 == 0, "1,1").alias("direction"), when.alias("resolves"), "p")


@query("brier_by_source", f"WITH {_ROUND} SELECT source, count(*) AS n, count(*) FILTER (WHERE missing) AS missing, round(avg(brier), 6) AS brier FROM sc GROUP BY ALL")
def brier_by_source(spark, sf_dir):
    return bm.brier_by_source(bm.score(resolutions(spark, sf_dir), forecasts(spark, sf_dir))).withColumn("brier", F.round("brier", 6))


_SUB = "round(avg(brier), 6) AS overall, round(avg(brier) FILTER (WHERE market), 6) AS market, round(avg(brier) FILTER (WHERE NOT market), 6) AS dataset, count(*) AS n, count(*) FILTER (WHERE missing) AS missing, round((coalesce(avg(brier) FILTER (WHERE market), avg(brier) FILTER (WHERE NOT market)) + coalesce(avg(brier) FILTER (WHERE NOT market), avg(brier) FILTER (WHERE market))) / 2, 6) AS pooled"


@query("submission_score", f"WITH {_ROUND} SELECT {_SUB} FROM sc")
def submission_score(spark, sf_dir):
    got = bm.submission_score(bm.score(resolutions(spark, sf_dir), forecasts(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 6) for c in ("overall", "market", "dataset", "pooled")})


@query("rounds_pooled", f"WITH {_ROUND} SELECT round, {_SUB} FROM sc GROUP BY ALL")
def rounds_pooled(spark, sf_dir):
    """The same score round by round."""
    got = bm.submission_score(bm.score(resolutions(spark, sf_dir), forecasts(spark, sf_dir)), ["round"])
    return got.withColumns({c: F.round(c, 6) for c in ("overall", "market", "dataset", "pooled")})


@query("baseline_scores", f"WITH {_ROUND}, b AS (SELECT market, pow(CASE WHEN market THEN r.p ELSE 0.5::DOUBLE END - res.outcome, 2) AS crowd FROM res JOIN rated r ON r.doc_id = res.question) SELECT market, count(*) AS n, round(avg(crowd), 6) AS crowd, 0.25::DOUBLE AS uniform FROM b GROUP BY ALL")
def baseline_scores(spark, sf_dir):
    """The crowd's value on markets and one half elsewhere, against one half everywhere."""
    res = resolutions(spark, sf_dir)
    rated = domain.rated(spark, sf_dir).select(F.col("doc_id").alias("question"), "p")
    crowd = bm.score(res, res.filter("market").join(rated, "question").select("question", "direction", "resolves", "p"))
    return crowd.groupBy("market").agg(F.count("*").alias("n"), F.round(F.avg("brier"), 6).alias("crowd"), F.lit(0.25).alias("uniform"))


@query("forecast_coverage", f"WITH {_ROUND} SELECT market, count(*) AS n, round(count(*) FILTER (WHERE question IN (SELECT question FROM fc)) / count(*), 6) AS covered, count(*) FILTER (WHERE question IN (SELECT question FROM fc)) / count(*) >= 0.95 AS enough FROM res GROUP BY ALL")
def forecast_coverage(spark, sf_dir):
    return bm.coverage(resolutions(spark, sf_dir), forecasts(spark, sf_dir)).withColumn("covered", F.round("covered", 6))


@query("gap_policy", f"""WITH {_ROUND}, s AS (SELECT question, res.source, market, CASE WHEN market AND question % 3 <> 0 THEN greatest(0.02::DOUBLE, least(0.98::DOUBLE, 1 / (1 + exp(-(1.2::DOUBLE * ln(greatest(1e-6, least(1 - 1e-6, r.p)) / (1 - greatest(1e-6, least(1 - 1e-6, r.p))))))))) WHEN NOT market AND question % 5 <> 0 THEN r.p END AS signal,
  CASE WHEN question % 2 = 1 OR question % 4 = 0 THEN 0.25::DOUBLE END AS reply FROM res JOIN rated r ON r.doc_id = res.question)
SELECT question, source, market, round(coalesce(signal, reply, 0.5), 6) AS p, CASE WHEN signal IS NOT NULL THEN CASE WHEN market THEN 'crowd' ELSE 'quant' END WHEN reply IS NOT NULL THEN 'reply' ELSE 'half' END AS how FROM s""")
def gap_policy(spark, sf_dir):
    """A signal wins, a reply fills gaps, the rest is one half."""
    q = resolutions(spark, sf_dir).select("question", "source", "market")
    p = domain.rated(spark, sf_dir).select(F.col("doc_id").alias("question"), "p")
    replies = q.filter("question % 2 = 1 OR question % 4 = 0").select("question", F.lit(0.25).alias("p"))
    return bm.filled(q, p.filter("question % 3 <> 0"), p.filter("question % 5 <> 0"), replies).withColumn("p", F.round("p", 6))


@query("reply_parsing", r"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'I think {"probability": ' || doc_id || '} no: {"probability": 0.' || (doc_id % 97) || ', "why": "x"}' WHEN 1 THEN 'none {"p": 1}' WHEN 2 THEN '{"probability": "0.5"} {"probability": null}' ELSE 'no braces' END AS reply FROM labels),
o AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(reply, '\{[^{}]*\}'), lambda x: try_cast(regexp_extract(x, '"probability":\s*"?([-0-9.]+)', 1) AS DOUBLE)), lambda v: v IS NOT NULL) AS ps FROM r)
SELECT doc_id, CASE WHEN len(ps) > 0 THEN greatest(0.03::DOUBLE, least(0.97::DOUBLE, ps[-1])) END AS p FROM o""")
def reply_parsing(spark, sf_dir):
    i = F.col("doc_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit('I think {"probability": '), i, F.lit('} no: {"probability": 0.'), i % 97, F.lit(', "why": "x"}'))).when(i % 4 == 1, 'none {"p": 1}').when(i % 4 == 2, '{"probability": "0.5"} {"probability": null}').otherwise("no braces")
    return domain.table(spark, sf_dir, "labels").select("doc_id", bm.parsed_reply(reply).alias("p"))


@query("holdout_leak_free", f"WITH {RATED}, a AS (SELECT 2020 + doc_id % 5 AS determined, CASE WHEN doc_id % 11 <> 0 THEN p END AS p, outcome FROM rated) SELECT count(*) AS n, round(avg(pow(p - outcome, 2)), 6) AS brier, round(avg(outcome) * (1 - avg(outcome)), 6) AS brier_base, 0.25::DOUBLE AS brier_half, round(avg(((p >= 0.5) = (outcome = 1))::INT), 6) AS hit_rate FROM a WHERE determined > 2022 AND p IS NOT NULL")
def holdout_leak_free(spark, sf_dir):
    a = domain.rated(spark, sf_dir).select((2020 + F.col("doc_id") % 5).alias("determined"), F.when(F.col("doc_id") % 11 != 0, F.col("p")).alias("p"), "outcome")
    return bm.leak_free(a, F.lit(2022)).withColumns({c: F.round(c, 6) for c in ("brier", "brier_base", "hit_rate")})
