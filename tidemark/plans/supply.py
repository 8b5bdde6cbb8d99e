"""Supply graphs as named queries: demand reaches regions, nations and suppliers; suppliers of one nation stand in for each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import domain
from ..streaming.flows import cut
from .catalog import query

_GRAPH = """nodes AS (
  SELECT 'demand' AS node, 'assay' AS kind, 'world' AS chain, NULL::DOUBLE AS supply, NULL::DOUBLE AS sd
  UNION ALL SELECT 'r' || r_regionkey, 'material', r_name, 8.0 + r_regionkey, 0.8 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'equipment', r_name, 4.0 + n_nationkey % 5, 0.5 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 's' || s_suppkey, 'consumable', r_name, 2.0 + s_suppkey % 7, 0.3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sup AS (SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt FROM supplier),
edges AS (
  SELECT 'demand' AS src, 'r' || r_regionkey AS dst, 'depends_on' AS rel, (100 - r_regionkey * 5) / 100.0::DOUBLE AS weight FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'depends_on', (90 + n_nationkey % 3 * 5) / 100.0::DOUBLE FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 6), 'depends_on', 0.97::DOUBLE FROM nation WHERE n_nationkey + 6 < 25
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'depends_on', (80 + s_suppkey % 5 * 5) / 100.0::DOUBLE FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 's' || nxt, 'substitutes', (10 + s_suppkey % 4 * 10) / 100.0::DOUBLE FROM sup WHERE nxt IS NOT NULL)"""
_PRESSURE = f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT 'demand' AS node, 10.0::DOUBLE AS required UNION ALL SELECT e.dst, w.required * e.weight FROM walk w JOIN edges e ON e.src = w.node WHERE e.rel = 'depends_on'),
need AS (SELECT node, max(required) AS required FROM walk GROUP BY ALL),
sub AS (SELECT src AS node, least(0.95::DOUBLE, sum(weight)) AS sub FROM edges WHERE rel = 'substitutes' GROUP BY ALL),
pr AS (SELECT node, kind, chain, required, supply, coalesce(sub, 0) AS sub, required / supply * (1 - coalesce(sub, 0)) AS pressure FROM need JOIN nodes USING (node) LEFT JOIN sub USING (node) WHERE supply IS NOT NULL)"""


def nodes(spark, sf_dir):
    t = lambda n: domain.table(spark, sf_dir, n)
    row = lambda name, kind, chain, supply, sd: [name.alias("node"), F.lit(kind).alias("kind"), chain.alias("chain"), supply.cast("double").alias("supply"), F.lit(sd).cast("double").alias("supply_sd")]
    region, nation = t("region"), t("nation")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    demand = spark.range(1).select(*row(F.lit("demand"), "assay", F.lit("world"), F.lit(None), None))
    r = region.select(*row(F.concat(F.lit("r"), "r_regionkey"), "material", F.col("r_name"), 8 + F.col("r_regionkey"), 0.8))
    n = named.select(*row(F.concat(F.lit("n"), "n_nationkey"), "equipment", F.col("r_name"), 4 + F.col("n_nationkey") % 5, 0.5))
    s = t("supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey")).select(*row(F.concat(F.lit("s"), "s_suppkey"), "consumable", F.col("r_name"), 2 + F.col("s_suppkey") % 7, 0.3))
    return demand.unionByName(r).unionByName(n).unionByName(s)


def edges(spark, sf_dir):
    t = lambda n: domain.table(spark, sf_dir, n)
    row = lambda src, dst, rel, weight: [src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (weight / F.lit(100.0)).alias("weight"), F.lit(0.02).alias("weight_sd")]
    name = lambda p, c: F.concat(F.lit(p), F.col(c) if isinstance(c, str) else c)
    a = t("region").select(*row(F.lit("demand"), name("r", "r_regionkey"), "depends_on", 100 - F.col("r_regionkey") * 5))
    b = t("nation").select(*row(name("r", "n_regionkey"), name("n", "n_nationkey"), "depends_on", 90 + F.col("n_nationkey") % 3 * 5))
    c = t("nation").filter("n_nationkey + 6 < 25").select(*row(name("n", "n_nationkey"), name("n", F.col("n_nationkey") + 6), "depends_on", F.lit(97)))
    d = t("supplier").select(*row(name("n", "s_nationkey"), name("s", "s_suppkey"), "depends_on", 80 + F.col("s_suppkey") % 5 * 5))
    nxt = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    e = t("supplier").withColumn("nxt", nxt).filter("nxt IS NOT NULL").select(*row(name("s", "s_suppkey"), name("s", "nxt"), "substitutes", 10 + F.col("s_suppkey") % 4 * 10))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def _needs(spark, sf_dir):
    return graph.required(edges(spark, sf_dir), F.col("kind") == "assay", 10.0, nodes(spark, sf_dir), cut)


def _pressures(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.pressures(n, edges(spark, sf_dir), _needs(spark, sf_dir)).join(n.select("node", "chain"), "node")


def _short(name: str):
    """Seven digits, where products of short decimals don't lie half-way between two results as they do at a decimal place."""
    return F.col(name).cast("float").cast("double")


@query("graph_pressure", f"{_PRESSURE} SELECT node, kind, required::FLOAT::DOUBLE AS required, supply, sub::FLOAT::DOUBLE AS sub, pressure::FLOAT::DOUBLE AS pressure FROM pr")
def graph_pressure(spark, sf_dir):
    """Required multiple and pressure of every supplied node after a tenfold shock of demand."""
    return _pressures(spark, sf_dir).select("node", "kind", _short("required").alias("required"), "supply", _short("sub").alias("sub"), _short("pressure").alias("pressure"))


@query("graph_bottleneck", f"{_PRESSURE} SELECT arg_max(node, struct_pack(p := pressure, n := node)) AS bottleneck, round(max(pressure), 9) AS pressure, arg_max(node, struct_pack(p := pressure, n := node)) FILTER (WHERE kind = 'equipment') AS obvious FROM pr")
def graph_bottleneck(spark, sf_dir):
    return graph.bottleneck(_pressures(spark, sf_dir)).withColumn("pressure", F.round("pressure", 9))


@query("supply_pressure_board", f"{_PRESSURE}, k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pressure::FLOAT DESC, node) AS place FROM pr) SELECT chain, node, kind, pressure::FLOAT::DOUBLE AS pressure, place FROM k WHERE place <= 5")
def supply_pressure_board(spark, sf_dir):
    """The five nodes of each chain under the greatest pressure."""
    p = _pressures(spark, sf_dir).withColumn("pressure", _short("pressure"))
    return graph.ranked(p, ["chain"], 5).select("chain", "node", "kind", "pressure", "place")


@query("cross_domain_board", f"WITH {_GRAPH} SELECT src, dst, rel, weight, a.chain AS src_chain, b.chain AS dst_chain FROM edges JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.chain <> b.chain")
def cross_domain_board(spark, sf_dir):
    return graph.cross_chain(nodes(spark, sf_dir), edges(spark, sf_dir)).select("src", "dst", "rel", "weight", "src_chain", "dst_chain")


@query("graph_nodes_board", f"WITH {_GRAPH}, so AS (SELECT 'n' || n_nationkey AS node, 50 + n_nationkey AS trust FROM nation) SELECT node, kind, supply, trust::INT AS trust FROM nodes LEFT JOIN so USING (node) WHERE chain = 'ASIA' ORDER BY node")
def graph_nodes_board(spark, sf_dir):
    """Nodes of one chain with their sources' trust."""
    so = domain.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), (50 + F.col("n_nationkey")).alias("trust"))
    return nodes(spark, sf_dir).filter("chain = 'ASIA'").join(so, "node", "left").select("node", "kind", "supply", "trust").orderBy("node")


@query("graph_edges_board", f"WITH {_GRAPH} SELECT src, dst, rel, weight FROM edges JOIN nodes ON node = src WHERE chain = 'ASIA'")
def graph_edges_board(spark, sf_dir):
    n = nodes(spark, sf_dir).filter("chain = 'ASIA'").select(F.col("node").alias("src"))
    return edges(spark, sf_dir).join(n, "src", "left_semi").select("src", "dst", "rel", "weight")


@query("world_nodes_board", f"WITH {_GRAPH} SELECT node, kind, chain, coalesce(CASE kind WHEN 'material' THEN 1 WHEN 'equipment' THEN 2 END, 99) AS layer FROM nodes WHERE chain IN ('ASIA', 'EUROPE')")
def world_nodes_board(spark, sf_dir):
    layer = F.coalesce(F.when(F.col("kind") == "material", 1).when(F.col("kind") == "equipment", 2), F.lit(99))
    return nodes(spark, sf_dir).filter(F.col("chain").isin("ASIA", "EUROPE")).select("node", "kind", "chain", layer.alias("layer")).orderBy("layer", "node")


@query("world_edges_board", f"WITH {_GRAPH} SELECT src, dst, rel, weight, chain AS src_chain FROM edges JOIN nodes ON node = src WHERE chain IN ('ASIA', 'EUROPE')")
def world_edges_board(spark, sf_dir):
    n = nodes(spark, sf_dir).filter(F.col("chain").isin("ASIA", "EUROPE")).select(F.col("node").alias("src"), F.col("chain").alias("src_chain"))
    return edges(spark, sf_dir).join(n, "src").select("src", "dst", "rel", "weight", "src_chain")


_SHARE = f"{_PRESSURE}, sh AS (SELECT node, pressure / (SELECT sum(pressure) FROM pr) AS p FROM pr)"


def _shares(spark, sf_dir):
    p = cut(_pressures(spark, sf_dir))
    return p.crossJoin(F.broadcast(p.agg(F.sum("pressure").alias("all")))).select("node", (F.col("pressure") / F.col("all")).alias("p_bottleneck"))  # one row


@query("drill_targets", f"{_SHARE}, me AS (SELECT 'n' || n_nationkey AS node, 50 + n_nationkey AS trust, CASE WHEN n_nationkey % 4 = 0 THEN 0.75::DOUBLE END AS health FROM nation) SELECT node, round(p, 9) AS p_bottleneck, coalesce(health, trust / 100.0::DOUBLE * 0.5::DOUBLE, 0) AS coverage, round(p * (1 - coalesce(health, trust / 100.0::DOUBLE * 0.5::DOUBLE, 0)), 9) AS drill FROM sh LEFT JOIN me USING (node)")
def drill_targets(spark, sf_dir):
    """Where data are thinnest at the likely bottleneck, with each node's share of pressure as its probability."""
    n = F.col("n_nationkey")
    measured = domain.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n).alias("node"), (50 + n).alias("trust"), F.when(n % 4 == 0, 0.75).alias("health"))
    return graph.drill_targets(_shares(spark, sf_dir), measured).withColumns({c: F.round(c, 9) for c in ("p_bottleneck", "drill")})


@query("constraint_cards", f"{_SHARE}, q AS (SELECT node, round(p, 9) AS p FROM sh), old AS (SELECT 'n' || n_nationkey AS node, 'card-' || n_nationkey AS card_id FROM nation) SELECT sha256('constraint|' || node || '|' || printf('%.6f', p)) AS card_id, node, p, old.card_id AS supersedes FROM q LEFT JOIN old USING (node) WHERE p >= 0.002::DOUBLE")
def constraint_cards(spark, sf_dir):
    old = domain.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("card-"), "n_nationkey").alias("card_id"), F.lit(-1.0).alias("p"))
    return graph.constraint_cards(_shares(spark, sf_dir).withColumn("p_bottleneck", F.round("p_bottleneck", 9)), old, 0.002)


@query("graph_propagation")
def graph_propagation(spark, sf_dir):
    """Probability of each node to be the bottleneck over 200,000 draws (Monte Carlo, so no SQL)."""
    return graph.propagate(nodes(spark, sf_dir), edges(spark, sf_dir), _needs(spark, sf_dir))


@query("graph_variance_budget")
def graph_variance_budget(spark, sf_dir):
    """Which uncertain input of a nation's supply, known exactly, would sharpen the bottleneck most (Monte Carlo, so no SQL)."""
    n = nodes(spark, sf_dir).filter("kind <> 'consumable'")
    e = edges(spark, sf_dir).filter("rel = 'depends_on'")
    return graph.variance_budget(n, e, _needs(spark, sf_dir))


@query("supply_cycles", """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey = 9),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
SELECT a.src AS node, max(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src""")
def supply_cycles(spark, sf_dir):
    """Nations that supply each other round a circle, and the circles' names."""
    n = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edge = lambda d, dst: d.select("src", dst.cast("int").alias("dst"))
    e = edge(n, (F.col("src") * 7 + 3) % 25).unionByName(edge(n.filter("src % 4 = 0"), (F.col("src") + 5) % 25)).unionByName(edge(n.filter("src = 9"), F.col("src")))
    return graph.strongly_connected(e, cut)


_ASKED = """top AS (SELECT chain, arg_max(node, struct_pack(p := pressure, n := node)) AS tight, arg_max(node, struct_pack(p := pressure, n := node)) FILTER (WHERE kind = 'equipment') AS obvious FROM pr GROUP BY chain),
asked AS (SELECT chain, 'Verify ' || chain || ': is ' || tight || ' the binding constraint' || CASE WHEN obvious IS NOT NULL AND obvious <> tight THEN ', not ' || obvious ELSE '' END || '?' AS prompt FROM top)"""


@query("verification_prompts", f"{_PRESSURE}, {_ASKED} SELECT chain, prompt, 'confirm,adjust,reject' AS options, 'confirm' AS recommendation, 'propagation of ' || chain AS blocks FROM asked WHERE chain <> 'ASIA'")
def verification_prompts(spark, sf_dir):
    """What must be verified before each chain's shock flows; one prompt is open already."""
    p = cut(_pressures(spark, sf_dir))
    none = spark.createDataFrame([], "prompt string, status string")
    known = graph.verification(p.filter("chain = 'ASIA'"), "chain", none).select("prompt", F.lit("open").alias("status"))
    got = graph.verification(p, "chain", known)
    return got.select("chain", "prompt", F.array_join("options", ",").alias("options"), "recommendation", "blocks")


@query("verification_record", f"{_PRESSURE}, {_ASKED} SELECT prompt, CASE WHEN chain = 'EUROPE' THEN 'open' ELSE 'decided' END AS status, CASE WHEN chain <> 'EUROPE' THEN 'confirm' END AS chosen FROM asked")
def verification_record(spark, sf_dir):
    """The record after answers: the first closes a prompt."""
    asked = graph.verification(cut(_pressures(spark, sf_dir)), "chain", spark.createDataFrame([], "prompt string, status string"))
    opened = cut(asked.select("chain", "prompt", F.lit("open").alias("status"), F.lit(None).cast("string").alias("chosen"), F.lit(None).cast("int").alias("decided")))
    said = opened.filter("chain <> 'EUROPE'").select("prompt", F.explode(F.array(F.struct(F.lit("confirm").alias("choice"), F.lit(1).alias("at")), F.struct(F.lit("reject").alias("choice"), F.lit(2).alias("at")))).alias("a")).select("prompt", "a.*")
    return graph.recorded(opened, said).select("prompt", "status", "chosen")
