"""Audits, the discovery funnel and the boards that show them, as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, inference, quality, series, store
from ..sources import domain
from ..streaming.flows import cut
from .catalog import MONTHLY, detect_sql, med, query

TODAY = "2004-02-01"
META = """meta AS (
  SELECT DISTINCT p_brand || '|' || p_type AS series_id, p_brand AS entity,
    CASE p_type WHEN 'ECONOMY' THEN 'arxiv' WHEN 'PROMO' THEN 'owid' WHEN 'STANDARD' THEN 'openalex' WHEN 'LARGE' THEN 'sec_edgar' WHEN 'MEDIUM' THEN 'nih_reporter' ELSE 'synthetic' END AS provider,
    'units' AS unit, CASE WHEN p_brand <> 'Brand#5' THEN 's-' || p_type END AS source_id, p_brand <> 'Brand#7' AS source_ok FROM part),
links AS (SELECT entity, series_id FROM meta WHERE entity <> 'Brand#3')"""
OBS = """obs AS (
  SELECT series_id, make_date((x::INT - 1) // 12, (x::INT - 1) % 12 + 1, 1) AS x, y, CASE WHEN series_id LIKE 'Brand#9|%' AND x = 1998 * 12 + 3 THEN 'kg' ELSE 'units' END AS unit,
    CASE WHEN series_id LIKE 'Brand#11|L%' THEN -1.0::DOUBLE ELSE sqrt(y) END AS uncertainty FROM pts),
first AS (SELECT p_brand || '|' || p_type AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS x, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 GROUP BY ALL),
rev AS (SELECT series_id FROM first JOIN pts USING (series_id, x) WHERE first.y <> pts.y)"""
_HEALTH = f"""{META}, {OBS},
lst AS (SELECT series_id, max(x) AS last FROM obs GROUP BY ALL),
fr0 AS (SELECT series_id, provider, last, CASE provider WHEN 'arxiv' THEN 120 WHEN 'nih_reporter' THEN 3 WHEN 'owid' THEN 3 ELSE 2 END AS most, date_diff('day', last, DATE '{TODAY}') AS days, 2004 - year(last) AS years FROM meta LEFT JOIN lst USING (series_id)),
fr AS (SELECT series_id, CASE WHEN provider <> 'synthetic' THEN days END AS days_stale, CASE WHEN provider = 'synthetic' THEN 'ok' WHEN last IS NULL THEN 'fail'
  WHEN provider = 'arxiv' THEN CASE WHEN days <= most THEN 'ok' WHEN days <= 2 * most THEN 'warn' ELSE 'fail' END
  ELSE CASE WHEN years <= most THEN 'ok' WHEN years <= most + 1 THEN 'warn' ELSE 'fail' END END AS fresh FROM fr0),
yrs AS (SELECT DISTINCT series_id, year(x) AS yr FROM obs),
gp AS (SELECT series_id, yr, yr - lag(yr) OVER (PARTITION BY series_id ORDER BY yr) - 1 AS gap FROM yrs),
cp AS (SELECT series_id, max(yr) - min(yr) + 1 - count(*) AS gaps, CASE WHEN (max(yr) - min(yr) + 1 - count(*)) / (max(yr) - min(yr) + 1) > 0.2 OR coalesce(max(gap), 0) >= 3 THEN 'fail' WHEN max(yr) - min(yr) + 1 > count(*) THEN 'warn' ELSE 'ok' END AS complete FROM gp GROUP BY ALL),
vl0 AS (SELECT series_id, count(*) FILTER (WHERE unit <> 'units') + count(*) FILTER (WHERE y < 0) + count(*) FILTER (WHERE uncertainty < 0) AS bad, list(y) FILTER (WHERE y > 0) AS plus FROM obs GROUP BY ALL),
vl1 AS (SELECT *, CASE WHEN len(plus) >= 5 THEN {med("plus")} END AS mid FROM vl0),
vl AS (SELECT series_id, CASE WHEN bad > 0 THEN 0 ELSE coalesce(len(list_filter(plus, lambda v: v > mid * 100 OR v < mid / 100)), 0) END AS outliers, bad FROM vl1),
en AS (SELECT series_id, CASE WHEN count(*) >= 3 THEN CASE WHEN arg_max(y, x) > arg_min(y, x) * 1.05::DOUBLE THEN 1 WHEN arg_max(y, x) < arg_min(y, x) * 0.95::DOUBLE THEN -1 ELSE 0 END END AS way FROM obs GROUP BY ALL),
torn AS (SELECT entity, coalesce(bool_or(way = 1) AND bool_or(way = -1), false) AS torn FROM links LEFT JOIN en USING (series_id) GROUP BY ALL),
rc AS (SELECT series_id, CASE WHEN torn AND way IS NOT NULL THEN 'warn' ELSE 'ok' END AS recon FROM links JOIN torn USING (entity) LEFT JOIN en USING (series_id)),
rv AS (SELECT series_id, count(*) AS n_revisions FROM rev GROUP BY ALL),
ck AS (SELECT meta.series_id, meta.entity, meta.provider, fresh, coalesce(complete, 'ok') AS complete, CASE WHEN bad IS NULL OR bad > 0 THEN 'fail' WHEN outliers > 0 THEN 'warn' ELSE 'ok' END AS valid,
  CASE WHEN source_id IS NULL THEN CASE WHEN provider = 'synthetic' THEN 'ok' ELSE 'fail' END WHEN NOT source_ok THEN 'fail' ELSE 'ok' END AS prov, coalesce(recon, 'n/a') AS recon, days_stale, coalesce(gaps, 0) AS gaps, coalesce(outliers, 0) AS outliers, coalesce(n_revisions, 0) AS n_revisions
  FROM meta LEFT JOIN fr USING (series_id) LEFT JOIN cp USING (series_id) LEFT JOIN vl USING (series_id) LEFT JOIN rc USING (series_id) LEFT JOIN rv USING (series_id)),
health AS MATERIALIZED (SELECT *, CASE WHEN 'fail' IN (fresh, complete, valid, prov, recon) THEN 'fail' WHEN 'warn' IN (fresh, complete, valid, prov, recon) THEN 'warn' ELSE 'ok' END AS status,
  round((25 * w(fresh) + 25 * w(complete) + 20 * w(valid) + 20 * w(prov) + 10 * w(recon)) / 1000.0::DOUBLE, 3) AS score FROM ck)"""
for _c in ("fresh", "complete", "valid", "prov", "recon"):
    _HEALTH = _HEALTH.replace(f"w({_c})", f"(CASE {_c} WHEN 'fail' THEN 0 WHEN 'warn' THEN 6 ELSE 10 END)")
HEALTH = f"{MONTHLY}, {_HEALTH}"


def meta(spark, sf_dir):
    """series_id, entity, provider, unit, source_id, source_ok, is_count of every series of parts."""
    kinds = {"ECONOMY": "arxiv", "PROMO": "owid", "STANDARD": "openalex", "LARGE": "sec_edgar", "MEDIUM": "nih_reporter"}
    provider = F.lit("synthetic")
    for k, v in kinds.items():
        provider = F.when(F.col("p_type") == k, v).otherwise(provider)
    p = domain.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return p.select(F.concat_ws("|", "p_brand", "p_type").alias("series_id"), F.col("p_brand").alias("entity"), provider.alias("provider"), F.lit("units").alias("unit"), F.when(F.col("p_brand") != "Brand#5", F.concat(F.lit("s-"), "p_type")).alias("source_id"), (F.col("p_brand") != "Brand#7").alias("source_ok"), F.lit(True).alias("is_count"))


def observations(points):
    m = F.col("x") - 1
    odd = F.col("series_id").startswith("Brand#9|") & (F.col("x") == 1998 * 12 + 3)
    return points.select("series_id", F.make_date(F.floor(m / 12).cast("int"), (m % 12).cast("int") + 1, F.lit(1)).alias("x"), "y", F.when(odd, "kg").otherwise("units").alias("unit"), F.when(F.col("series_id").startswith("Brand#11|L"), -1.0).otherwise(F.sqrt("y")).alias("uncertainty"))


def links(spark, sf_dir):
    return meta(spark, sf_dir).filter("entity <> 'Brand#3'").select("entity", "series_id")


def revisions(spark, sf_dir):
    """One row for each point whose value changed between the first three lines of each order and all of them: both sums in one pass."""
    part = domain.table(spark, sf_dir, "part").select("p_partkey", domain.series_name().alias("series_id"))
    items = domain.table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("x"), "l_quantity", "l_linenumber")
    g = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("series_id", "x").agg(F.sum("l_quantity").alias("new"), F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity"))).alias("old"))
    return g.filter("old <> new").select("series_id")


def health(spark, sf_dir, points=None):
    """The audit of every series; points: domain.monthly, where a run has it already."""
    points = cut(domain.monthly(spark, sf_dir)) if points is None else points  # the audit's checks each read them
    return quality.audit(meta(spark, sf_dir), observations(points), links(spark, sf_dir), revisions(spark, sf_dir), F.lit(TODAY).cast("date"))


@query("quality_audit", f"WITH {HEALTH} SELECT series_id, status, fresh, complete, valid, prov, recon, days_stale::INT AS days_stale, gaps::INT AS gaps, outliers::INT AS outliers, n_revisions, score FROM health")
def quality_audit(spark, sf_dir):
    """The five checks of every series, the worst and the weighted score."""
    return health(spark, sf_dir).withColumn("gaps", F.col("gaps").cast("int"))


@query("data_health_board", f"WITH {HEALTH} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS fail, round(avg(score) * 100, 1) AS score FROM health")
def data_health_board(spark, sf_dir):
    s = lambda v: F.count_if(F.col("status") == v).alias(v)
    return health(spark, sf_dir).agg(F.count("*").alias("n"), s("ok"), s("warn"), s("fail"), F.round(F.avg("score") * 100, 1).alias("score"))


@query("worst_series_board", f"WITH {HEALTH} SELECT series_id, status, score FROM health WHERE status <> 'ok' ORDER BY CASE status WHEN 'fail' THEN 0 ELSE 1 END, score, series_id LIMIT 14")
def worst_series_board(spark, sf_dir):
    bad = health(spark, sf_dir).filter("status <> 'ok'").select("series_id", "status", "score")
    return bad.orderBy(F.when(F.col("status") == "fail", 0).otherwise(1), "score", "series_id").limit(14)


@query("orphan_points", f"WITH {MONTHLY}, {META} SELECT series_id, count(*) AS points FROM pts WHERE series_id NOT IN (SELECT series_id FROM meta WHERE entity <> 'Brand#3' AND provider <> 'synthetic') GROUP BY ALL")
def orphan_points(spark, sf_dir):
    known = meta(spark, sf_dir).filter("entity <> 'Brand#3' AND provider <> 'synthetic'")
    return quality.orphans(domain.monthly(spark, sf_dir), known).groupBy("series_id").agg(F.count("*").alias("points"))


@query("look_ahead_violations", f"WITH {MONTHLY}, c AS (SELECT series_id, 1998 * 12 + 12 AS origin, count(*) FILTER (WHERE x <= 1998 * 12 + 12 + CASE WHEN series_id LIKE 'Brand#1|%' THEN 1 ELSE 0 END) AS n_known FROM pts GROUP BY ALL) SELECT series_id, origin, n_known, n_seen FROM (SELECT c.*, (SELECT count(*) FROM pts WHERE pts.series_id = c.series_id AND x <= origin) AS n_seen FROM c) WHERE n_seen <> n_known")
def look_ahead_violations(spark, sf_dir):
    """Recorded counts of known points against recounted ones; here one brand's record looks a month ahead on purpose."""
    pts, o = domain.monthly(spark, sf_dir), 1998 * 12 + 12
    ahead = F.when(F.col("series_id").startswith("Brand#1|"), 1).otherwise(0)
    cases = pts.groupBy("series_id").agg(F.count_if(F.col("x") <= o + ahead).alias("n_known")).withColumn("origin", F.lit(o))
    return quality.look_ahead(cases, pts).select("series_id", "origin", "n_known", "n_seen")


_SCAN = f"""{HEALTH}, {detect_sql(k=1.5)},
live AS MATERIALIZED (SELECT det.*, meta.entity, meta.provider FROM det JOIN meta USING (series_id) JOIN health USING (series_id) WHERE health.status <> 'fail' AND meta.provider <> 'synthetic'),
pv AS MATERIALIZED (SELECT *, (1 + (SELECT count(*) FROM live o WHERE o.down_surprise >= live.surprise)) / (1 + (SELECT count(*) FROM live))::DOUBLE AS p FROM live),
bh AS MATERIALIZED (SELECT *, (SELECT count(*) FROM pv o WHERE o.p <= pv.p) AS rnk, (SELECT count(*) FROM pv) AS m FROM pv),
scan AS MATERIALIZED (SELECT *, p <= coalesce((SELECT max(p) FROM bh WHERE p <= rnk / m * 0.5::DOUBLE), -1) AS survive FROM bh)"""


def scan(spark, sf_dir, q: float = 0.5, points=None):
    """Detect on every series that is live and did not fail its audit, with p, rank and survival at rate q."""
    points = cut(domain.monthly(spark, sf_dir)) if points is None else points
    live = discovery.live_series(meta(spark, sf_dir), health(spark, sf_dir, points)).select("series_id", "entity", "provider")
    det = series.detect(points.join(live.select("series_id"), "series_id", "left_semi"), ["series_id"], k=1.5).join(live, "series_id")
    return inference.benjamini_hochberg(cut(discovery.mirrored_p(cut(det))), "p", q)


@query("fdr_survivors", f"WITH {_SCAN} SELECT series_id, provider, round(surprise, 6) AS surprise, round(p, 9) AS p, rnk AS rank, survive, (SELECT round(0.5::DOUBLE * count(*), 6) FROM scan WHERE survive) AS expected_false FROM scan")
def fdr_survivors(spark, sf_dir):
    """All live series with their mirrored p; survivors at rate one half (the data are near-stationary), and how many of them are
    expected to be false."""
    s = cut(scan(spark, sf_dir))
    false = s.agg(F.round(F.lit(0.5) * F.count_if("survive"), 6).alias("expected_false"))
    return s.crossJoin(F.broadcast(false)).select("series_id", "provider", F.round("surprise", 6).alias("surprise"), F.round("p", 9).alias("p"), "rank", "survive", "expected_false")  # one row


_SAT = "sat AS (SELECT p_brand AS entity, round(count(DISTINCT p_size) / 50.0::DOUBLE, 3) AS saturation, CASE WHEN round(count(DISTINCT p_size) / 50.0::DOUBLE, 3) >= 0.9::DOUBLE THEN 'priced/known' ELSE 'pre_consensus' END AS verdict FROM part WHERE p_brand NOT LIKE 'Brand#2%' GROUP BY ALL)"


@query("pre_consensus", f"""WITH {_SCAN}, {_SAT}, tk AS (SELECT DISTINCT p_brand AS entity FROM part WHERE p_brand LIKE 'Brand#1%'),
evd AS (SELECT entity, coalesce(bool_or(provider IN ('owid', 'nih_reporter', 'arxiv') AND fired AND survive), false) AS leads, coalesce(bool_or(provider IN ('openalex', 'sec_edgar') AND fired), false) AS lags,
  coalesce(bool_or(provider IN ('nih_reporter', 'arxiv') AND fired AND survive), false) AS fine, coalesce(max(greatest(surprise, 0)) FILTER (WHERE provider IN ('owid', 'nih_reporter', 'arxiv') AND fired AND survive), 0) AS lead_sigma,
  count(*) FILTER (WHERE provider IN ('owid', 'nih_reporter', 'arxiv')) AS n_lead, count(*) FILTER (WHERE provider IN ('openalex', 'sec_edgar')) AS n_lag, count(*) FILTER (WHERE provider NOT IN ('owid', 'nih_reporter', 'arxiv', 'openalex', 'sec_edgar')) AS n_unclassified
  FROM scan JOIN links USING (entity, series_id) GROUP BY ALL),
k AS (SELECT evd.*, saturation, leads AND NOT lags AND coalesce(verdict = 'priced/known', false) AS demoted, leads AND NOT fine AS coarse_only, tk.entity IS NOT NULL AS has_ticker FROM evd LEFT JOIN sat USING (entity) LEFT JOIN tk ON tk.entity = evd.entity),
c AS (SELECT *, CASE WHEN leads AND NOT lags AND NOT demoted THEN 'EARLY' WHEN leads THEN 'PRICED' WHEN lags THEN 'LAGGING' ELSE 'QUIET' END AS class FROM k)
SELECT entity, class, round(lead_sigma, 6) AS lead_sigma, coarse_only, n_lead, n_lag, n_unclassified, saturation, demoted, has_ticker,
  CASE WHEN class = 'EARLY' THEN row_number() OVER (PARTITION BY class ORDER BY coarse_only, coalesce(saturation, 1), lead_sigma DESC, entity) END AS place FROM c""")
def pre_consensus(spark, sf_dir):
    """Entities that lead before the crowd: leads survive the control, lags only fire, measured saturation demotes."""
    part = domain.table(spark, sf_dir, "part")
    s = F.round(F.count_distinct("p_size") / 50.0, 3)
    sat = part.filter(~F.col("p_brand").startswith("Brand#2")).groupBy(F.col("p_brand").alias("entity")).agg(s.alias("saturation")).withColumn("verdict", F.when(F.col("saturation") >= 0.9, "priced/known").otherwise("pre_consensus"))
    tickers = part.filter(F.col("p_brand").startswith("Brand#1")).select(F.col("p_brand").alias("entity"))
    evidence = scan(spark, sf_dir).join(links(spark, sf_dir), ["entity", "series_id"])
    return discovery.pre_consensus(evidence, sat, tickers).withColumn("lead_sigma", F.round("lead_sigma", 6))


@query("discovery_board", f"""WITH {_SCAN}, evd AS (SELECT entity, bool_or(provider IN ('owid', 'nih_reporter', 'arxiv') AND fired AND survive) AS leads, bool_or(provider IN ('openalex', 'sec_edgar') AND fired) AS lags FROM scan JOIN links USING (entity, series_id) GROUP BY ALL),
c AS (SELECT CASE WHEN leads AND NOT lags THEN 'EARLY' WHEN leads THEN 'PRICED' WHEN lags THEN 'LAGGING' ELSE 'QUIET' END AS class FROM evd) SELECT class, count(*) AS entities FROM c GROUP BY ALL""")
def discovery_board(spark, sf_dir):
    """How many entities there are of each class, without saturation."""
    none = spark.createDataFrame([], "entity string, saturation double, verdict string")
    evidence = scan(spark, sf_dir).join(links(spark, sf_dir), ["entity", "series_id"])
    return discovery.pre_consensus(evidence, none, none.select("entity")).groupBy("class").agg(F.count("*").alias("entities"))


@query("series_board", f"""WITH {MONTHLY}, {META}, {detect_sql()}, ep AS (SELECT series_id, count(*) AS n_obs, min(x)::INT AS first_x, max(x)::INT AS last_x, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y FROM pts GROUP BY ALL)
SELECT series_id, provider, coalesce(fired::INT, -1) AS fired, round(coalesce(surprise, -1), 6) AS surprise, n_obs, first_x, last_x, first_y, last_y FROM meta LEFT JOIN det USING (series_id) LEFT JOIN ep USING (series_id)""")
def series_board(spark, sf_dir):
    """Every series with its verdict and endpoints; fired first, then by surprise."""
    pts = domain.monthly(spark, sf_dir)
    det = series.detect(pts, ["series_id"]).select("series_id", "fired", "surprise")
    df = meta(spark, sf_dir).select("series_id", "provider").join(det, "series_id", "left").join(store.endpoints(pts).drop("spark"), "series_id", "left")
    df = df.withColumn("fired", F.coalesce(F.col("fired").cast("int"), F.lit(-1))).withColumn("surprise", F.round(F.coalesce("surprise", F.lit(-1.0)), 6))
    return df.orderBy(F.desc("fired"), F.desc("surprise"), "series_id")


@query("detector_run", f"""WITH {_SCAN} SELECT (SELECT count(DISTINCT series_id) FROM meta)::BIGINT AS series, (SELECT count(*) FROM health WHERE status = 'fail')::BIGINT AS failed, count(*) AS judged, count(*) FILTER (WHERE fired) AS fired FROM scan""")
def detector_run(spark, sf_dir):
    """A detector run's summary: series that failed their audit are skipped."""
    points = cut(domain.monthly(spark, sf_dir))
    h = health(spark, sf_dir, points).agg(F.count("*").alias("series"), F.count_if(F.col("status") == "fail").alias("failed"))
    return h.crossJoin(scan(spark, sf_dir, points=points).agg(F.count("*").alias("judged"), F.count_if("fired").alias("fired")))  # one row each


_FILERS = """fl AS (SELECT upper('t' || s_suppkey) AS ticker, 1000 + s_suppkey AS cik FROM supplier WHERE s_suppkey % 5 <> 0),
pr AS (SELECT p_brand AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'elastic' ELSE 'inelastic' END AS layer, ' t' || p_partkey % 23 AS symbol, p_name AS name, (p_partkey % 10) / 10.0::DOUBLE AS confidence FROM part),
ins AS (SELECT entity, ticker AS symbol, layer, cik, arg_max(ticker || ' [' || layer || '] ' || substr(name, 1, 40), struct_pack(c := confidence, n := name)) AS label, least(max(confidence), 0.7::DOUBLE) AS confidence FROM pr JOIN fl ON upper(trim(symbol)) = ticker GROUP BY ALL)"""


def _instruments(spark, sf_dir):
    s, part = domain.table(spark, sf_dir, "supplier"), domain.table(spark, sf_dir, "part")
    filers = s.filter("s_suppkey % 5 <> 0").select(F.upper(F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))).alias("ticker"), (1000 + F.col("s_suppkey")).alias("cik"))
    key = F.col("p_partkey")
    proposals = part.select(F.col("p_brand").alias("entity"), F.when(key % 2 == 0, "elastic").otherwise("inelastic").alias("layer"), F.concat(F.lit(" t"), (key % 23).cast("string")).alias("symbol"), F.col("p_name").alias("name"), (key % 10 / F.lit(10.0)).alias("confidence"))
    return discovery.instruments(proposals, filers)


@query("instrument_candidates", f"WITH {_FILERS} SELECT * FROM ins")
def instrument_candidates(spark, sf_dir):
    """Proposed instruments of entities whose symbols are filers'."""
    return _instruments(spark, sf_dir)


@query("instrument_pairs", f"""WITH {_FILERS}, a AS (SELECT * FROM ins WHERE confidence >= 0.5::DOUBLE),
b AS (SELECT entity, min(symbol) FILTER (WHERE layer = 'inelastic') AS inelastic, min(symbol) FILTER (WHERE layer = 'elastic') AS elastic FROM a GROUP BY ALL)
SELECT entity, inelastic, x.cik AS inelastic_cik, elastic, y.cik AS elastic_cik FROM b JOIN fl x ON x.ticker = inelastic JOIN fl y ON y.ticker = elastic""")
def instrument_pairs(spark, sf_dir):
    """Entities with an accepted instrument (those of at least one half) in both layers."""
    return discovery.pairs(_instruments(spark, sf_dir).filter("confidence >= 0.5"))
