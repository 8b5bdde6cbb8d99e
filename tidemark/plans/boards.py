"""The remaining boards: plain lists with their filters and orders, as named queries. Orders stand in for cards and ledger rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, store
from ..sources import domain, landed
from .catalog import query
from .scores import _CARDS, _cards


@query("pillars_board", "SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY id")
def pillars_board(spark, sf_dir):
    return domain.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).orderBy("id")


@query("sources_board", "SELECT s_suppkey AS id, s_name AS title, least(100, greatest(0, (s_acctbal / 100)::INT)) AS trust FROM supplier ORDER BY trust DESC, id")
def sources_board(spark, sf_dir):
    trust = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.col("s_acctbal") / 100, 0).cast("int")))
    return domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), trust.alias("trust")).orderBy(F.desc("trust"), "id")


@query("open_decisions_board", "SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS created, o_orderpriority AS prompt FROM orders WHERE o_orderstatus = 'O' ORDER BY created, id")
def open_decisions_board(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("created"), F.col("o_orderpriority").alias("prompt")).orderBy("created", "id")


_COST = """ledger AS (SELECT o_orderkey AS id, o_orderdate AS ts, (o_orderkey % 700)::INT AS est, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 400)::INT END AS actual, CASE WHEN o_orderstatus = 'P' THEN 'denied' WHEN o_orderkey % 700 <= 0 THEN 'auto' WHEN o_orderkey % 700 <= 500 THEN 'approved' ELSE 'pending' END AS status FROM orders)"""


def _cost(spark, sf_dir):
    i = F.col("o_orderkey")
    o = domain.table(spark, sf_dir, "orders").withColumn("est", (i % 700).cast("int"))
    return o.select(i.alias("id"), F.col("o_orderdate").alias("ts"), "est", F.when(i % 3 == 0, (i % 400).cast("int")).alias("actual"), F.when(F.col("o_orderstatus") == "P", "denied").otherwise(store.cost_status("est")).alias("status"))


@query("cost_ledger_board", f"WITH {_COST} SELECT * FROM ledger ORDER BY ts DESC, id")
def cost_ledger_board(spark, sf_dir):
    return _cost(spark, sf_dir).orderBy(F.desc("ts"), "id")


@query("spend_board", f"WITH {_COST} SELECT coalesce(sum(coalesce(actual, est)), 0)::BIGINT AS cents FROM ledger WHERE status <> 'denied'")
def spend_board(spark, sf_dir):
    """What has been spent: actual cents where known, else the estimate; denied rows cost nothing."""
    return _cost(spark, sf_dir).filter("status <> 'denied'").agg(F.coalesce(F.sum(F.coalesce("actual", "est")), F.lit(0)).alias("cents"))


@query("cost_gate", f"WITH {_COST} SELECT status, count(*) AS n, sum(est)::BIGINT AS est, count(*) FILTER (WHERE status = 'pending') AS refused FROM ledger GROUP BY ALL")
def cost_gate(spark, sf_dir):
    return _cost(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("est").alias("est"), F.count_if(F.col("status") == "pending").alias("refused"))


@query("forecasts_board", f"WITH {_CARDS} SELECT card_id, kind, p FROM cards WHERE card_id NOT IN (SELECT supersedes FROM cards WHERE supersedes IS NOT NULL) AND kind NOT LIKE '5%' ORDER BY card_id DESC")
def forecasts_board(spark, sf_dir):
    """Live cards that are no rungs, the newest first."""
    return scoring.live(_cards(spark, sf_dir)).filter(~F.col("kind").like("5%")).select("card_id", "kind", "p").orderBy(F.desc("card_id"))


@query("live_calls", f"WITH {_CARDS} SELECT card_id, kind, p FROM cards WHERE card_id NOT IN (SELECT supersedes FROM cards WHERE supersedes IS NOT NULL) AND outcome IS NULL AND kind <> ''")
def live_calls(spark, sf_dir):
    """Forward calls: live, unresolved, of some thesis."""
    return scoring.live(_cards(spark, sf_dir)).filter("outcome IS NULL AND kind <> ''").select("card_id", "kind", "p")


@query("belief_net", f"WITH {_CARDS}, e AS (SELECT b.card_id AS dst, a.card_id AS src, least(0.99::DOUBLE, b.p + 0.15::DOUBLE) AS p_true, coalesce(a.outcome::DOUBLE, a.p) AS pf, a.outcome AS fo, coalesce(b.outcome::DOUBLE, b.p) AS pt FROM cards b JOIN cards a ON b.parent_id = a.card_id) SELECT src, dst, round(pt, 6) AS prior, round(CASE WHEN fo IS NULL THEN p_true END, 6) AS if_true, round(CASE WHEN fo IS NULL AND pf < 1 THEN (pt - p_true * pf) / (1 - pf) END, 6) AS if_false FROM e")
def belief_net(spark, sf_dir):
    c = _cards(spark, sf_dir)
    e = c.alias("b").filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("card_id").alias("dst"), F.least(F.lit(0.99), F.col("p") + 0.15).alias("p_true"))
    return scoring.belief_net(e, c)[0].withColumns({k: F.round(k, 6) for k in ("prior", "if_true", "if_false")})


@query("belief_islands", f"WITH {_CARDS} SELECT card_id FROM cards c WHERE parent_id IS NULL AND outcome IS NULL AND NOT EXISTS (SELECT 1 FROM cards b WHERE b.parent_id = c.card_id)")
def belief_islands(spark, sf_dir):
    """Live roots that no edge touches."""
    c = _cards(spark, sf_dir)
    e = c.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("card_id").alias("dst"), F.lit(0.5).alias("p_true"))
    return scoring.belief_net(e, c)[1]


@query("calibration_points_board", f"WITH {_CARDS} SELECT card_id, p, outcome, round(pow(p - outcome, 2), 6) AS brier FROM cards WHERE outcome IS NOT NULL AND kind NOT LIKE '5%'")
def calibration_points_board(spark, sf_dir):
    c = _cards(spark, sf_dir).filter(F.col("outcome").isNotNull() & ~F.col("kind").like("5%"))
    return c.select("card_id", "p", "outcome", F.round(F.pow(F.col("p") - F.col("outcome"), 2), 6).alias("brier"))


_SPARK = "sp AS (SELECT p_brand AS series_id, year(l_shipdate) * 12 + month(l_shipdate) AS x, round(avg(l_discount), 4) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query("sparklines", f"WITH {_SPARK} SELECT series_id, count(*) AS n_obs, min(x) AS first_x, max(x) AS last_x, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y, string_agg(format('{{:g}}', y), ',' ORDER BY x) AS spark FROM sp GROUP BY ALL")
def sparklines(spark, sf_dir):
    """Endpoints and sparkline of fractions."""
    part = domain.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    i = domain.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return store.endpoints(i.groupBy("series_id", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("x")).agg(F.round(F.avg("l_discount"), 4).alias("y")))


_TABLES = ("customer", "events", "nation", "no_such_table", "orders", "part", "region", "supplier")


@query("missing_table", " UNION ALL ".join(f"SELECT '{t}' AS name, {'0::BIGINT' if t.startswith('no') else f'(SELECT count(*) FROM {t})'} AS n" for t in _TABLES).replace("'nation' AS name, 0::BIGINT", "'nation' AS name, (SELECT count(*) FROM nation)"))
def missing_table(spark, sf_dir):
    """Rows of the tables that a board reads; one that does not exist reads as an empty one."""
    got = None
    for t in _TABLES:
        n = landed.table_or_empty(spark, f"{sf_dir}/{t}.parquet", "one int").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        got = n if got is None else got.unionByName(n)
    return got


_UPSERT = """cur AS (SELECT o_orderkey AS k, o_totalprice AS v, 'old' AS note FROM orders WHERE o_orderkey % 3 <> 0),
inc AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS note FROM orders WHERE o_orderkey % 2 = 0)"""


def _two(spark, sf_dir):
    o, k = domain.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cur = o.filter(k % 3 != 0).select(k.alias("k"), F.col("o_totalprice").alias("v"), F.lit("old").alias("note"))
    v = F.when(k % 4 == 0, F.col("o_totalprice") + 1).when(k % 4 != 1, F.col("o_totalprice"))
    return cur, o.filter(k % 2 == 0).select(k.alias("k"), v.alias("v"), F.when(k % 5 != 0, "new").alias("note"))


@query("coalesce_merge", f"WITH {_UPSERT} SELECT k, coalesce(inc.v, cur.v) AS v, coalesce(inc.note, cur.note) AS note FROM cur FULL JOIN inc USING (k)")
def coalesce_merge(spark, sf_dir):
    return store.coalesce_merge(*_two(spark, sf_dir), ["k"], ["v", "note"])


@query("natural_key_upsert", f"WITH {_UPSERT} SELECT k, CASE WHEN inc.k IS NOT NULL THEN inc.v ELSE cur.v END AS v, CASE WHEN inc.k IS NOT NULL THEN inc.note ELSE cur.note END AS note FROM cur FULL JOIN inc USING (k)")
def natural_key_upsert(spark, sf_dir):
    return store.upsert(*_two(spark, sf_dir), ["k"])


@query("partition_rewrite", f"WITH {_UPSERT} SELECT * FROM cur WHERE k % 10 NOT IN (SELECT k % 10 FROM inc) UNION ALL SELECT * FROM inc")
def partition_rewrite(spark, sf_dir):
    """Delete and rewrite: partitions that come in replace their old rows."""
    cur, inc = _two(spark, sf_dir)
    part = lambda d: d.withColumn("g", F.col("k") % 10)
    return store.rewrite(part(cur), part(inc), ["g"]).drop("g")


@query("bulk_upsert_counts", f"WITH {_UPSERT} SELECT (SELECT count(*) FROM inc) AS written, (SELECT count(*) FROM inc JOIN cur USING (k) WHERE cur.v <> inc.v) AS revised")
def bulk_upsert_counts(spark, sf_dir):
    cur, inc = _two(spark, sf_dir)
    return store.upsert_counts(cur.withColumnRenamed("v", "value"), inc.withColumnRenamed("v", "value"), ["k"])


@query("content_hashes", "SELECT n_nationkey AS id, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS sha256 FROM nation")
def content_hashes(spark, sf_dir):
    """The hash of each row as JSON with sorted keys."""
    n = domain.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), store.content_hash(*n.columns).alias("sha256"))


@query("sealed_chain", "WITH l AS (SELECT n_nationkey AS id, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation) SELECT count(*) AS n, sha256(string_agg(h, '' ORDER BY id)) AS seal FROM l")
def sealed_chain(spark, sf_dir):
    """One seal over the sorted rows of a table."""
    return store.chain(domain.table(spark, sf_dir, "nation"), "n_nationkey")


