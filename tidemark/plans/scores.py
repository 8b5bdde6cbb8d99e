"""Calibration, cards, scenario trees and the store as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, store
from ..sources import domain
from ..streaming.flows import cut
from .catalog import RATED, query

_LL = "-CASE WHEN outcome = 1 THEN ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))) ELSE ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p))) END"
_CAL = f"count(*) AS n, round(avg(pow(p - outcome, 2)), 6) AS brier, round(avg(pow(0.5::DOUBLE - outcome, 2)), 6) AS brier_half, round(avg({_LL}), 6) AS log_loss, round(avg(((p >= 0.5) = (outcome = 1))::INT), 6) AS hit_rate, round(avg(outcome), 6) AS base_rate"
_R = lambda df, *n: df.withColumns({c: F.round(c, 6) for c in n})


def _cal(df):
    return _R(df, "brier", "brier_half", "log_loss", "hit_rate", "base_rate")


@query("calibration", f"WITH {RATED} SELECT {_CAL} FROM rated")
def calibration(spark, sf_dir):
    return _cal(scoring.calibration(domain.rated(spark, sf_dir)))


@query("calibration_by_source", f"WITH {RATED} SELECT source, {_CAL} FROM rated GROUP BY ALL")
def calibration_by_source(spark, sf_dir):
    return _cal(scoring.calibration(domain.rated(spark, sf_dir), ["source"]))


@query("reliability_bins", f"WITH {RATED} SELECT least(4, floor(p * 5))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(outcome), 6) AS rate FROM rated GROUP BY ALL")
def reliability_bins(spark, sf_dir):
    return _R(scoring.reliability(domain.rated(spark, sf_dir)), "mean_p", "rate")


@query("discrimination_auc", f"""WITH {RATED}, a AS (SELECT p FROM rated WHERE outcome = 1), b AS (SELECT p FROM rated WHERE outcome = 0)
SELECT (SELECT count(*) FROM a) AS n_pos, (SELECT count(*) FROM b) AS n_neg, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE), 6) AS auc FROM a, b""")
def discrimination_auc(spark, sf_dir):
    return _R(scoring.auc(domain.rated(spark, sf_dir)), "auc")


@query("persistence_vs_model", f"WITH {RATED} SELECT lang, count(*) AS n, round(avg(pow(p - outcome, 2)), 6) AS model, round(avg(pow(second - outcome, 2)), 6) AS persistence FROM rated JOIN documents USING (doc_id) GROUP BY ALL")
def persistence_vs_model(spark, sf_dir):
    r = domain.rated(spark, sf_dir).join(domain.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)), 6).alias("model"), F.round(F.avg(F.pow((F.col("second") - F.col("outcome")).cast("double"), 2)), 6).alias("persistence"))


@query("crowd_anchor", f"""WITH {RATED}, c AS (SELECT doc_id, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) AS q FROM rated),
l AS (SELECT doc_id, 1 / (1 + exp(-(1.2::DOUBLE * ln(q / (1 - q))))) AS v FROM c) SELECT doc_id, round(greatest(0.02::DOUBLE, least(0.98::DOUBLE, v)), 6) AS anchored FROM l""")
def crowd_anchor(spark, sf_dir):
    return domain.rated(spark, sf_dir).select("doc_id", F.round(scoring.extremized(F.col("p")), 6).alias("anchored"))


# A card for each order: the customer's earlier order is its parent, a few supersede each other.
_CARDS = """cards AS (
  SELECT o_orderkey AS card_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_id,
    CASE WHEN o_orderkey % 7 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS supersedes,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome, o_orderpriority AS kind, round(0.2::DOUBLE + (o_orderkey % 60) / 100.0::DOUBLE, 6) AS p FROM orders)"""


def _cards(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = domain.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("card_id"), before.alias("parent_id"), F.when(F.col("o_orderkey") % 7 == 0, before).alias("supersedes"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("outcome"), F.col("o_orderpriority").alias("kind"), F.round(F.lit(0.2) + (F.col("o_orderkey") % 60) / F.lit(100.0), 6).alias("p"))


@query("live_cards", f"WITH {_CARDS} SELECT kind, count(*) AS live, count(outcome) AS resolved FROM cards WHERE card_id NOT IN (SELECT supersedes FROM cards WHERE supersedes IS NOT NULL) GROUP BY ALL")
def live_cards(spark, sf_dir):
    return scoring.live(_cards(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("live"), F.count("outcome").alias("resolved"))


@query("void_conditionals", f"WITH {_CARDS} SELECT c.kind, count(*) AS cards, count(*) FILTER (WHERE q.outcome = 0) AS void, round(avg(pow(c.p - c.outcome, 2)) FILTER (WHERE c.outcome IS NOT NULL AND q.outcome IS DISTINCT FROM 0), 6) AS brier FROM cards c LEFT JOIN cards q ON c.parent_id = q.card_id GROUP BY ALL")
def void_conditionals(spark, sf_dir):
    v = scoring.unresolvable(_cards(spark, sf_dir))
    return v.groupBy("kind").agg(F.count("*").alias("cards"), F.count_if("void").alias("void"), F.round(F.avg(F.when(~F.col("void") & F.col("outcome").isNotNull(), F.pow(F.col("p") - F.col("outcome"), 2))), 6).alias("brier"))


@query("base_rates_by_kind", f"WITH {_CARDS}, u AS (SELECT kind, outcome, p FROM cards WHERE outcome IS NOT NULL UNION ALL SELECT 'corpus', outcome, 0.5 FROM cards WHERE outcome IS NOT NULL AND card_id % 5 = 0) SELECT kind, count(*) AS n, round(avg(outcome), 6) AS rate, round(avg(pow(p - outcome, 2)), 6) AS brier FROM u GROUP BY ALL")
def base_rates_by_kind(spark, sf_dir):
    c = _cards(spark, sf_dir).filter("outcome IS NOT NULL")
    u = c.select("kind", "outcome", "p").unionByName(c.filter("card_id % 5 = 0").select(F.lit("corpus").alias("kind"), "outcome", F.lit(0.5).alias("p")))
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("rate"), F.round(F.avg(F.pow(F.col("p") - F.col("outcome"), 2)), 6).alias("brier"))


# The scenario tree: world -> region -> nation -> segment; a conditional is a share of customers.
_TREE = """n AS (SELECT n_regionkey AS r, n_nationkey AS k, c_mktsegment AS s, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
tree AS (
  SELECT 'world' AS card_id, NULL AS parent_id, 1.0::DOUBLE AS p
  UNION ALL SELECT 'r' || r, 'world', sum(c) / (SELECT sum(c) FROM n)::DOUBLE FROM n GROUP BY r
  UNION ALL SELECT 'n' || k, 'r' || r, sum(c) / (sum(sum(c)) OVER (PARTITION BY r))::DOUBLE FROM n GROUP BY r, k
  UNION ALL SELECT 'n' || k || s, 'n' || k, c / (sum(c) OVER (PARTITION BY k))::DOUBLE FROM n)"""


def _tree(spark, sf_dir):
    from pyspark.sql import Window

    n = domain.table(spark, sf_dir, "customer").join(F.broadcast(domain.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey", "c_mktsegment").agg(F.count("*").alias("c"))  # nation: 25 rows
    share = lambda df, part: F.col("c") / F.sum("c").over(Window.partitionBy(*part)).cast("double")
    region = n.groupBy("n_regionkey").agg(F.sum("c").alias("c"))
    nation = n.groupBy("n_regionkey", "n_nationkey").agg(F.sum("c").alias("c"))
    root = spark.range(1).select(F.lit("world").alias("card_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1.0).alias("p"))
    r = region.select(F.concat(F.lit("r"), "n_regionkey").alias("card_id"), F.lit("world").alias("parent_id"), share(region, [F.lit(1)]).alias("p"))
    k = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("card_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), share(nation, ["n_regionkey"]).alias("p"))
    s = n.select(F.concat(F.lit("n"), "n_nationkey", "c_mktsegment").alias("card_id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), share(n, ["n_nationkey"]).alias("p"))
    return root.unionByName(r).unionByName(k).unionByName(s)


@query("scenario_marginals", f"WITH RECURSIVE {_TREE}, walk AS (SELECT card_id, 0 AS depth, p AS marginal FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.card_id, depth + 1, marginal * t.p FROM walk JOIN tree t ON t.parent_id = walk.card_id) SELECT card_id, depth, round(marginal, 9) AS marginal FROM walk")
def scenario_marginals(spark, sf_dir):
    return scoring.marginals(_tree(spark, sf_dir), cut).withColumns({"marginal": F.round("marginal", 9), "depth": F.col("depth").cast("int")})


@query("scenario_incoherent", f"WITH {_TREE}, bent AS (SELECT card_id, parent_id, CASE WHEN card_id LIKE 'n1%' THEN p * 1.01::DOUBLE ELSE p END AS p FROM tree) SELECT parent_id, round(sum(p), 6) AS total, count(*) AS children FROM bent WHERE parent_id IS NOT NULL GROUP BY ALL HAVING abs(sum(p) - 1) > 0.005")
def scenario_incoherent(spark, sf_dir):
    bent = _tree(spark, sf_dir).withColumn("p", F.when(F.col("card_id").startswith("n1"), F.col("p") * 1.01).otherwise(F.col("p")))
    return scoring.sums_to_one(bent).withColumn("total", F.round("total", 6))


@query("belief_edges", f"WITH {_CARDS}, e AS (SELECT a.card_id AS src, b.card_id AS dst, a.p AS p_from, b.p AS p_to, least(0.99::DOUBLE, b.p + 0.15::DOUBLE) AS p_true FROM cards b JOIN cards a ON b.parent_id = a.card_id), f AS (SELECT *, (p_to - p_true * p_from) / (1 - p_from) AS p_false FROM e) SELECT src, dst, round(p_false, 6) AS p_false, p_false BETWEEN 0 AND 1 AND p_true > p_false AS coherent FROM f")
def belief_edges(spark, sf_dir):
    c = _cards(spark, sf_dir)
    e = c.alias("b").join(c.alias("a"), F.col("b.parent_id") == F.col("a.card_id")).select(F.col("a.card_id").alias("src"), F.col("b.card_id").alias("dst"), F.col("a.p").alias("p_from"), F.col("b.p").alias("p_to"))
    e = e.withColumn("p_true", F.least(F.lit(0.99), F.col("p_to") + 0.15)).withColumn("p_false", scoring.given_false(F.col("p_to"), F.col("p_true"), F.col("p_from")))
    return e.select("src", "dst", F.round("p_false", 6).alias("p_false"), (F.col("p_false").between(0, 1) & (F.col("p_true") > F.col("p_false"))).alias("coherent"))


# The store: monthly quantities as known from the first three lines of each order, then from all of them.
_OLD = """cur AS (SELECT p_brand AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS x, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 GROUP BY ALL),
inc AS (SELECT p_brand AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS x, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _states(spark, sf_dir):
    part = domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    items = domain.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    x = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("x")
    state = lambda d, when: d.groupBy("series_id", x).agg(F.sum("l_quantity").alias("value")).withColumn("uncertainty", F.sqrt("value")).withColumn("unit", F.lit("units")).withColumn("created", F.lit(when).cast("timestamp"))
    return state(items.filter("l_linenumber <= 3"), "2024-01-01"), state(items, "2024-02-01")


@query("store_latest", f"WITH {_OLD} SELECT series_id, x, coalesce(inc.value, cur.value) AS value, round(sqrt(coalesce(inc.value, cur.value)), 6) AS uncertainty, CASE WHEN cur.value IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created FROM cur FULL JOIN inc USING (series_id, x)")
def store_latest(spark, sf_dir):
    latest, _ = store.merge(*_states(spark, sf_dir))
    return latest.select("series_id", "x", "value", F.round("uncertainty", 6).alias("uncertainty"), F.date_format("created", "yyyy-MM-dd").alias("created"))


@query("store_revisions", f"WITH {_OLD} SELECT series_id, x, cur.value AS old_value, inc.value AS new_value FROM cur JOIN inc USING (series_id, x) WHERE cur.value <> inc.value")
def store_revisions(spark, sf_dir):
    _, revisions = store.merge(*_states(spark, sf_dir))
    return revisions.select("series_id", "x", "old_value", "new_value")


@query("store_as_of", f"WITH {_OLD} SELECT series_id, x, value FROM cur")
def store_as_of(spark, sf_dir):
    """The bitemporal read: values as they stood between the two loads."""
    latest, revisions = store.merge(*_states(spark, sf_dir))
    return store.as_of(revisions, latest, F.lit("2024-01-15").cast("timestamp")).select("series_id", "x", "value")


@query("series_endpoints", "WITH m AS (SELECT p_brand || '|' || p_type AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS x, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT series_id, count(*) AS n_obs, min(x) AS first_x, max(x) AS last_x, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y, string_agg(y::BIGINT::VARCHAR, ',' ORDER BY x) AS spark FROM m GROUP BY ALL")
def series_endpoints(spark, sf_dir):
    return store.endpoints(domain.monthly(spark, sf_dir))


@query("cost_gate", "WITH c AS (SELECT event_id, round(value * 100)::BIGINT AS cents FROM events) SELECT CASE WHEN cents <= 0 THEN 'auto' WHEN cents <= 500 THEN 'approved' ELSE 'pending' END AS status, count(*) AS n, sum(cents)::BIGINT AS cents FROM c GROUP BY ALL")
def cost_gate(spark, sf_dir):
    c = domain.table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"))
    return c.groupBy(store.cost_status().alias("status")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("insert_or_ignore", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def insert_or_ignore(spark, sf_dir):
    held = domain.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.missing_only(held, domain.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def last_wins(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return store.last_wins(o, ["o_custkey"], "at").select("o_custkey", "o_orderkey")
