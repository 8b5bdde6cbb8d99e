"""Supply graphs: a demand shock flows along dependencies, and the node that saturates first is the bottleneck.

nodes: node, kind, supply, supply_sd; edges: src, dst, rel, weight, weight_sd. Draws are tasks: (draw, node) pairs never meet the
driver. A task evaluates a block of draws over NODES nodes at most; more nodes are more tasks, and each draw's winner is the best of theirs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Greatest share of a node's demand that substitutes take; nodes of a task; edges that one task walks, and edges of one strongly
#: connected component; no normal number of numpy's lies further from 0 (its tail ends at 3.66 + 53 ln 2 / 3.66).
MOST_SUBSTITUTED, NODES, LOCAL, MEMBERS, FAR = 0.95, 20000, 100_000, 1_000_000, 14.0


def _trimmed(edges: DataFrame, cut) -> tuple[DataFrame, int]:
    """Edges whose ends both have an edge that comes in and one that goes out, again and again; how many are left."""
    n = edges.count()
    while n:
        live = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges, before = cut(live.select("src", "dst")), n
        n = edges.count()
        if n == before:
            break
    return edges, n


def strongly_connected(edges: DataFrame, cut) -> DataFrame:
    """node, component of the nodes that lie on a cycle; a component is named by its greatest node.

    Forward and backward colouring: every node takes the greatest name that reaches it, and of each colour those that reach the node
    of that name form a component; it is taken out, what can lie on no cycle any more is trimmed, and the rest is coloured anew.
    Rounds follow the lengths of paths in what is left. cut(frame) writes a frame and reads it again."""
    live, n = _trimmed(cut(edges.select("src", "dst").filter("src <> dst").distinct()), cut)
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    found = None
    while n:
        colour = cut(live.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        changed = 1
        while changed:
            ahead = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            colour = cut(colour.join(ahead, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("up")))
            changed = colour.filter("up").count()
            colour = colour.drop("up")
        inside = cut(live.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("colour")))
        reached = cut(colour.filter("node = colour"))
        front = reached
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour").distinct()
            front = cut(back.join(reached, "node", "left_anti"))
            reached = cut(reached.unionByName(front))
        part = reached.select("node", F.col("colour").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        live, n = _trimmed(cut(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")), cut)
    return loops if found is None else loops.join(found, "node", "left_anti").unionByName(found)


def _gain(edges) -> list | None:
    """A cycle whose weights multiply to more than 1, as its nodes in order, of (src, dst, weight) rows: Bellman and Ford's rounds over
    logarithms, from everywhere at once."""
    nodes = {v for s, d, _ in edges for v in (s, d)}
    height, via = dict.fromkeys(nodes, 0.0), {}
    last = None
    for _ in range(len(nodes) + 1):
        last = None
        for s, d, w in edges:
            if w > 0 and height[s] + np.log(w) > height[d] + 1e-12:
                height[d], via[d], last = height[s] + np.log(w), s, d
        if last is None:
            return None
    for _ in range(len(nodes)):
        last = via[last]
    cycle, v = [last], via[last]
    while v != last:
        cycle.append(v)
        v = via[v]
    return cycle[::-1]


def gaining_cycles(edges: DataFrame, cut) -> DataFrame:
    """component, cycle: of each strongly connected component that has one, a cycle whose weights multiply to more than 1, named by its
    nodes. A component's own edges are a group: MEMBERS of them at most."""
    parts = strongly_connected(edges, cut)
    own = edges.join(parts.toDF("src", "component"), "src").join(parts.toDF("dst", "other"), "dst").filter("component = other").select("component", "src", "dst", "weight")
    own = cut(own)
    largest = own.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > MEMBERS:
        raise ValueError(f"a strongly connected component has {largest} edges, over {MEMBERS}")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cycle = _gain(sorted(zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True)))
        return pd.DataFrame({"component": [key[0]], "cycle": [" > ".join(map(str, [*cycle, cycle[0]])) if cycle else None]})

    kind = edges.schema["src"].dataType.simpleString()
    return own.groupBy("component").applyInPandas(run, f"component {kind}, cycle string").filter("cycle IS NOT NULL")


def _relaxed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Start nodes and dependencies of a small graph: the greatest requirement of each node, or a cycle that raises it without end."""
    best = dict(zip(left["node"], left["required"], strict=True))
    after: dict = {}
    for s, d, w in zip(right["src"], right["dst"], right["weight"], strict=True):
        after.setdefault(s, []).append((d, w))
    most = len({*best, *right["src"], *right["dst"]})
    front = set(best)
    for _ in range(most + 1):
        new: dict = {}
        for s in front:
            for d, w in after.get(s, ()):
                v = best[s] * w
                if v > new.get(d, best.get(d, -np.inf)):
                    new[d] = v
        front = set(new)
        best.update(new)
        if not front:
            return pd.DataFrame({"node": list(best), "required": list(best.values()), "cycle": None})
    cycle = _gain(sorted(zip(right["src"], right["dst"], right["weight"], strict=True))) or ["?"]
    return pd.DataFrame({"node": [cycle[0]], "required": [0.0], "cycle": [" > ".join(map(str, [*cycle, cycle[0]]))]})


def required(edges: DataFrame, start: Column, shock: float, nodes: DataFrame, cut, local: int = LOCAL) -> DataFrame:
    """node, required: the shock times the greatest product of weights over all dependency paths from the start nodes.

    Up to `local` edges (counted) are walked in one task. Larger graphs take rounds of joins until nothing rises any more; `cut` (a
    function of a DataFrame) writes each round down and reads it again. A cycle whose weights multiply to more than 1 has no
    greatest path: it is refused, and the error names it."""
    deps = cut(edges.filter("rel = 'depends_on'").select("src", "dst", "weight"))
    begin = nodes.filter(start).select("node", F.lit(float(shock)).alias("required"))
    small = deps.count() <= local
    if small:
        one = F.lit(0).alias("one")
        kind = nodes.schema["node"].dataType.simpleString()
        got = cut(begin.groupBy(one).cogroup(deps.groupBy(one)).applyInPandas(_relaxed, f"node {kind}, required double, cycle string"))
        cycle = got.filter("cycle IS NOT NULL").first()
    else:
        cycle = gaining_cycles(deps, cut).first()
    if cycle:
        raise ValueError(f"dependencies form a cycle whose weights multiply to more than 1: {cycle['cycle']}")
    if small:
        return got.drop("cycle")
    reached = front = cut(begin)
    while True:
        step = front.join(deps.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("required") * F.col("weight")).alias("new"))
        front = cut(step.join(reached, "node", "left").filter("required IS NULL OR new > required").select("node", F.col("new").alias("required")))
        if front.isEmpty():
            return reached
        reached = cut(reached.join(front.select("node"), "node", "left_anti").unionByName(front))


def substitutability(edges: DataFrame) -> DataFrame:
    """node, sub: the summed capacity of a node's substitutes, 0.95 at most."""
    g = edges.filter("rel = 'substitutes'").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("s"))
    return g.select("node", F.least(F.lit(MOST_SUBSTITUTED), F.col("s")).alias("sub"))


def pressures(nodes: DataFrame, edges: DataFrame, needs: DataFrame) -> DataFrame:
    """node, kind, required, supply, sub, pressure of every node that is reached and has a supply."""
    df = needs.join(nodes.filter("supply IS NOT NULL"), "node").join(substitutability(edges), "node", "left").withColumn("sub", F.coalesce("sub", F.lit(0.0)))
    return df.select("node", "kind", "required", "supply", "sub", (F.col("required") / F.col("supply") * (1 - F.col("sub"))).alias("pressure"))


def bottleneck(p: DataFrame) -> DataFrame:
    """bottleneck, pressure, obvious: the node under the greatest pressure, and the first piece of equipment."""
    top = lambda c: F.max_by("node", F.struct("pressure", "node")) if c is None else F.max_by(F.when(c, F.col("node")), F.when(c, F.struct("pressure", "node")))
    return p.agg(top(None).alias("bottleneck"), F.max("pressure").alias("pressure"), top(F.col("kind") == "equipment").alias("obvious"))


def _inputs(nodes: DataFrame, edges: DataFrame, needs: DataFrame) -> DataFrame:
    """node, kind, required, supply, sd, subs of every node that is reached and has a supply."""
    subs = edges.filter("rel = 'substitutes'").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight", F.coalesce("weight_sd", F.lit(0.0)).alias("sd")))).alias("subs"))
    return needs.join(nodes.filter("supply IS NOT NULL"), "node").join(subs, "node", "left").select("node", "kind", "required", "supply", F.coalesce("supply_sd", F.lit(0.0)).alias("sd"), "subs")


def _parameters(nodes: DataFrame, edges: DataFrame, needs: DataFrame) -> pd.DataFrame:
    got = _inputs(nodes, edges, needs).limit(NODES + 1).toPandas().sort_values("node", ignore_index=True)
    if len(got) > NODES:
        raise ValueError(f"more than {NODES} supplied nodes: take the budget over parts of the graph")
    return got


def _best(table: pd.DataFrame, seed: int, block: int, n: int, zero: str | None = None, places=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest pressure, its node (index) and that node's gap in n draws. Every random number belongs to (seed, block, node's place),
    so leaving out one input's uncertainty, or dealing the nodes to several tasks, changes nothing else. Nodes whose pressure cannot
    pass the least of the best ones are not drawn."""
    best, win, gap_of = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n)
    least = -1.0
    for i, r in enumerate(table.itertuples(index=False)):
        if 0 <= r.required / max(1.0, r.supply - FAR * abs(r.sd)) <= least:
            continue
        rng = np.random.default_rng([seed, block, i if places is None else int(places[i])])
        sm = np.maximum(1.0, r.supply + rng.standard_normal(n) * (0.0 if zero == f"supply {r.node}" else r.sd))
        gap = r.required / sm
        if r.required >= 0 and not (gap > best).any():
            continue
        sub = np.zeros(n)
        for s in r.subs if r.subs is not None else ():
            sub += np.maximum(0.0, s["weight"] + rng.standard_normal(n) * (0.0 if zero == f"substitute {r.node} {s['dst']}" else s["sd"]))
        pressure = gap * (1 - np.minimum(MOST_SUBSTITUTED, sub))
        better = np.flatnonzero(pressure > best)
        if len(better):
            best[better], win[better], gap_of[better] = pressure[better], i, gap[better]
            least = best.min()
    return best, win, gap_of


def _draws(table: pd.DataFrame, seed: int, block: int, n: int, zero: str | None = None):
    """Winners (index) and gaps of n draws."""
    return _best(table, seed, block, n, zero)[1:]


def propagate(nodes: DataFrame, edges: DataFrame, needs: DataFrame, draws: int = 200_000, seed: int = 4, block: int = 10_000, share: int = NODES) -> DataFrame:
    """node, kind, p_bottleneck, and for each node the 10th, 50th and 90th percentile of its gap where it is the bottleneck
    (element min(n - 1, int(q n))).

    A task evaluates a block of draws over `share` nodes at most, which follow each other in order; a draw's winner is the best of
    the shares' (ties: the first), so the result does not depend on the share."""
    table = _inputs(nodes, edges, needs)
    kind, names = nodes.schema["node"].dataType.simpleString(), table.columns
    schema = StructType([*table.schema.fields, StructField("place", LongType())])
    placed = table.orderBy("node").rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(schema)
    blocks = nodes.sparkSession.range(0, -(-draws // block)).withColumnRenamed("id", "block")
    dealt = placed.withColumn("share", F.floor(F.col("place") / share)).crossJoin(F.broadcast(blocks))  # one row for each block

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, pdf = int(key[0]), pdf.sort_values("place", ignore_index=True)
        n = min(block, draws - b * block)
        best, win, gap = _best(pdf[names], seed, b, n, places=pdf["place"].to_numpy())
        return pd.DataFrame({"draw": b * block + np.arange(n), "pressure": best, "place": pdf["place"].to_numpy()[win], "node": pdf["node"].to_numpy()[win], "kind": pdf["kind"].to_numpy()[win], "gap": gap})

    won = dealt.groupBy("block", "share").applyInPandas(run, f"draw long, pressure double, place long, node {kind}, kind string, gap double")
    first = won.groupBy("draw").agg(F.max_by(F.struct("node", "kind", "gap"), F.struct("pressure", -F.col("place"))).alias("r")).select("r.*")
    g = first.groupBy("node", "kind").agg(F.count("*").alias("n"), F.percentile("gap", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return g.select("node", "kind", (F.col("n") / draws).alias("p_bottleneck"), F.col("q")[0].alias("gap_low"), F.col("q")[1].alias("gap_median"), F.col("q")[2].alias("gap_high"))


def variance_budget(nodes: DataFrame, edges: DataFrame, needs: DataFrame, draws: int = 20_000, seed: int = 4) -> DataFrame:
    """input, sigma, p, gain: how much the probability of the likeliest bottleneck rises if that input were known exactly; the
    same random numbers are used throughout. Each input is a task."""
    table = _parameters(nodes, edges, needs)
    base, _ = _draws(table, seed, 0, draws)
    modal = int(np.bincount(base, minlength=len(table)).argmax()) if len(table) else 0
    p0 = float((base == modal).mean())
    inputs = [(f"supply {r.node}", float(r.sd)) for r in table.itertuples() if r.sd > 0] + [(f"substitute {r.node} {s['dst']}", float(s["sd"])) for r in table.itertuples() if r.subs is not None for s in r.subs if s["sd"] > 0]

    def run(pdfs):
        for pdf in pdfs:
            p = [float((_draws(table, seed, 0, draws, zero)[0] == modal).mean()) for zero in pdf["input"]]
            yield pdf.assign(p=p, gain=[x - p0 for x in p])

    spark = nodes.sparkSession
    return spark.createDataFrame(inputs, "input string, sigma double").repartition(max(1, len(inputs))).mapInPandas(run, "input string, sigma double, p double, gain double")


def drill_targets(p: DataFrame, measured: DataFrame) -> DataFrame:
    """node, coverage, drill: where data are thinnest at the likely bottleneck. measured: node, trust (0 to 100), health (of the
    build series). A measured build series counts with its health, a mere source with half its trust."""
    df = p.join(measured, "node", "left")
    cover = F.coalesce("health", F.when(F.col("trust") > 0, F.col("trust") / 100 * 0.5), F.lit(0.0))
    return df.select("node", "p_bottleneck", cover.alias("coverage"), (F.col("p_bottleneck") * (1 - cover)).alias("drill"))


def constraint_cards(p: DataFrame, old: DataFrame, least: float = 0.05) -> DataFrame:
    """A card for each node that is the bottleneck with at least that probability: card_id, node, p, supersedes (the live card of
    the node, if its probability differs)."""
    card = p.filter(F.col("p_bottleneck") >= least).join(old.select("node", F.col("card_id").alias("last"), F.col("p").alias("was")), "node", "left")
    return card.filter("was IS NULL OR was <> p_bottleneck").select(F.sha2(F.concat_ws("|", F.lit("constraint"), "node", F.format_string("%.6f", "p_bottleneck")), 256).alias("card_id"), "node", F.col("p_bottleneck").alias("p"), F.col("last").alias("supersedes"))


def cross_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different chains, with both names and chains."""
    end = lambda n: nodes.select(F.col("node").alias(n), F.col("chain").alias(f"{n}_chain"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").filter("src_chain <> dst_chain")


def ranked(p: DataFrame, by: list[str], top: int) -> DataFrame:
    """The top nodes of each group by pressure."""
    return p.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pressure"), "node"))).filter(F.col("place") <= top)


def verification(p: DataFrame, by: str, decisions: DataFrame) -> DataFrame:
    """The question that must be answered before a chain's shock is propagated: by, prompt, options, recommendation, blocks, for every
    chain of p (node, kind, pressure) with a bottleneck; not where the same prompt is open already (decisions: prompt, status).

    The critical assumption is named: the bottleneck, and the piece of equipment under the greatest pressure, which one would think of
    first."""
    top = lambda c: F.max_by(F.when(c, F.col("node")), F.when(c, F.struct("pressure", "node")))
    g = p.groupBy(by).agg(F.max_by("node", F.struct("pressure", "node")).alias("tight"), top(F.col("kind") == "equipment").alias("obvious"))
    prompt = F.concat(F.lit("Verify "), by, F.lit(": is "), "tight", F.lit(" the binding constraint"), F.when(F.col("obvious").isNotNull() & (F.col("obvious") != F.col("tight")), F.concat(F.lit(", not "), "obvious")).otherwise(""), F.lit("?"))
    asked = g.select(by, prompt.alias("prompt"), F.array(F.lit("confirm"), F.lit("adjust"), F.lit("reject")).alias("options"), F.lit("confirm").alias("recommendation"), F.concat(F.lit("propagation of "), by).alias("blocks"))
    return asked.join(decisions.filter("status = 'open'").select("prompt"), "prompt", "left_anti")


def recorded(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """decisions with status, chosen and decided: the first answer to an open prompt closes it, later ones change nothing."""
    first = answers.groupBy("prompt").agg(F.min_by(F.struct("choice", "at"), F.struct("at", "choice")).alias("said"))
    d = decisions.join(first, "prompt", "left")
    closes = (F.col("status") == "open") & F.col("said").isNotNull()
    return d.withColumns({"chosen": F.when(closes, F.col("said.choice")).otherwise(F.col("chosen")), "decided": F.when(closes, F.col("said.at")).otherwise(F.col("decided")), "status": F.when(closes, "decided").otherwise(F.col("status"))}).drop("said")
