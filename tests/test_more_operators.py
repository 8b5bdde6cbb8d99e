"""Many patterns at once, exact resampling of blocks, cycles, trailing sets, rungs by the calendar."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus, graph, inference, ladder, matching, series
from tidemark.streaming import flows


@pytest.mark.parametrize("most", [3, 1 << 17])
def test_patterns_by_regular_expressions(spark, most):
    rng = random.Random(4)
    words = ["a", "ab", "b", "b_c", "the", "der", "süß", "x1", "Ab", "é"]
    texts = [(k, rng.choice([None, "", "  ", " ".join(rng.choice(words) + rng.choice(["", ",", "-", "\n", "."]) for _ in range(12))])) for k in range(80)]
    patterns = [*words, "a b", "THE  der", "b_c", None, " ", "süß é", "ab,"]
    df, ps = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(p,) for p in patterns], "p string")
    flat = lambda s: re.sub("[ \t\n\x0b\f\r]+", " ", s.lower())
    own = {flat(p).strip() for p in patterns if p and p.strip()}
    for whole in (True, False):
        got = sorted((r.k, r.p) for r in matching.occurrences(df, "text", ps, "p", whole, most=most).collect())
        edge = (r"(?<!\w)", r"(?!\w)") if whole else ("", "")
        assert got == sorted((k, p) for k, t in texts if t for p in own if re.search(edge[0] + re.escape(p) + edge[1], flat(t)))
    assert matching.occurrences(df, "text", ps.limit(0), "p").count() == 0


def test_blocks_are_resampled_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(f"b{k}", None if k % 9 else "x", *map(int, rng.integers(0, 6, 4))) for k in range(700)]
    blocks = spark.createDataFrame(rows, "block_0 string, block_1 string, a long, b long, c long, d long")
    got = inference.resampled(blocks, 400).orderBy("rep").toPandas()
    assert (got["times"] == 700).all() and len(got) == 400
    again = inference.resampled(blocks.repartition(7), 400).orderBy("rep").toPandas()
    assert got.equals(again)
    counts = np.array([r[2:] for r in rows])
    direct = np.array([counts[rng.integers(0, 700, 700)].sum(0) for _ in range(4000)])
    mine = got[["a", "b", "c", "d"]].to_numpy()
    assert np.allclose(mine.mean(0), direct.mean(0), rtol=0.02) and np.allclose(mine.std(0), direct.std(0), rtol=0.15)

    def lift(t):
        a, b, c, d = t.T
        return (a / (a + b)) / ((a + c) / (a + b + c + d))

    lo_hi = inference.block_bootstrap(blocks, 400).first()
    low, high = np.quantile(lift(direct), [0.05, 0.95])
    assert abs(lo_hi.lift_lo - low) < 0.02 and abs(lo_hi.lift_hi - high) < 0.02


def reach(edges):
    nodes = {v for e in edges for v in e}
    to = {v: {d for s, d in edges if s == v} for v in nodes}
    for _ in nodes:
        to = {v: to[v] | {x for w in to[v] for x in to[w]} for v in nodes}
    return to


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_reachability(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(20)})
    to = reach(edges)
    want = {v: max(w for w in to[v] if v in to[w]) for v in to if v in to[v]}
    got = {r.node: r.component for r in graph.strongly_connected(spark.createDataFrame(edges, "src string, dst string"), flows.cut).collect()}
    assert got == want


def test_refused_cycles_are_named(spark):
    nodes = spark.createDataFrame([(n, "assay" if n == "d" else "material", 1.0, 0.1) for n in "dabce"], "node string, kind string, supply double, supply_sd double")
    rows = [("d", "a", 1.0), ("a", "b", 2.0), ("b", "c", 0.9), ("c", "a", 0.6), ("c", "e", 1.0), ("e", "e", 0.5)]
    edges = spark.createDataFrame([(s, d, "depends_on", w, 0.0) for s, d, w in rows], "src string, dst string, rel string, weight double, weight_sd double")
    for local in (100, 0):
        with pytest.raises(ValueError, match="a > b > c > a|b > c > a > b|c > a > b > c"):
            graph.required(edges, F.col("kind") == "assay", 10.0, nodes, flows.cut, local=local)
        fine = graph.required(edges.filter("dst <> 'a' OR src <> 'c'"), F.col("kind") == "assay", 10.0, nodes, flows.cut, local=local)
        assert {r.node: round(r.required, 9) for r in fine.collect()} == {"d": 10.0, "a": 10.0, "b": 20.0, "c": 18.0, "e": 18.0}


def test_trailing_sets_by_python(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), f"20{rng.randrange(18, 21)}-{rng.randrange(1, 13):02d}", rng.choice([None, *[f"p{k}" for k in range(25)]])) for _ in range(400)]
    got = {(r.term, r.month): r.n for r in corpus.trailing_distinct(spark.createDataFrame(rows, "term string, month string, who string"), flows.cut, 5).collect()}
    at = lambda m: int(m[:4]) * 12 + int(m[5:])
    ok = [r for r in rows if r[0] and r[2]]
    assert got == {(t, m): len({w for u, k, w in ok if u == t and at(m) - 5 < at(k) <= at(m)}) for t, m, _ in ok}


def test_rungs_teach_the_origins_after_them(spark):
    rng = random.Random(8)
    rows = [(f"s{k}", 0, float(o), float(o + 2), *[rng.gauss(0, 1) for _ in range(5)], float(rng.random() < 0.5)) for k in range(300) for o in range(10)]
    rungs = spark.createDataFrame(rows, "series_id string, i int, origin double, resolves double, drift double, vol double, last double, accel double, drawdown double, y double").withColumn("i", F.col("origin").cast("int"))
    base = {r.origin: (r.n_known, r.base) for r in ladder.expanding_base_rate(rungs).collect()}
    for o in range(10):
        ys = [r[-1] for r in rows if r[3] <= o]
        assert base[o][0] == len(ys) and abs(base[o][1] - (sum(ys) / len(ys) if ys else 0.5)) < 1e-12
    plan = ladder.price(rungs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fitted = {r.origin: r.w is not None for r in ladder.price(rungs, min_train=600, sample=400).select("origin", F.col("price").alias("w")).collect()}
    assert len(fitted) == 10
    x = np.array([r[4:9] for r in rows if r[3] <= 7])
    w, b, mean, dev = ladder.fit_logistic(x, np.array([r[-1] for r in rows if r[3] <= 7]))
    got = {(r.series_id, r.i): r.price for r in ladder.price(rungs, min_train=600).filter("origin = 7").collect()}
    for r in rows:
        if r[2] == 7:
            z = ((np.array(r[4:9]) - mean) / dev) @ w + b
            assert abs(got[r[0], 7] - 1 / (1 + np.exp(-z))) < 1e-9


def test_rungs_resolve_by_the_calendar(spark):
    points = spark.createDataFrame([("a", float(x), float(y)) for x, y in ((0, 10), (3, 12), (4, 9), (9, 11), (20, 5))], "series_id string, x double, y double")
    rungs = spark.createDataFrame([("a", 0, 0.0, 10.0), ("a", 1, 3.0, 12.0), ("a", 2, 4.0, 9.0), ("a", 3, 18.0, 11.0), ("b", 0, 1.0, 1.0)], "series_id string, i int, origin double, threshold double")
    got = {(r.series_id, r.i): (r.due, r.seen_x, r.outcome) for r in ladder.resolved(rungs, points, 5.0).collect()}
    assert got == {("a", 0): (5.0, 4.0, 0), ("a", 1): (8.0, 4.0, 0), ("a", 2): (9.0, 9.0, 1), ("a", 3): (23.0, None, None), ("b", 0): (6.0, None, None)}


def test_features_of_rungs_by_a_loop(spark):
    rng = random.Random(3)
    ys = [max(0.0, 10 + rng.gauss(0, 3)) if rng.random() > 0.1 else 0.0 for _ in range(40)]
    got = {r.i: r for r in ladder.candidates(spark.createDataFrame([("a", float(x), y) for x, y in enumerate(ys)], "series_id string, x double, y double")).collect()}
    seen = 0
    for i in range(6, 38):
        h = ys[: i + 1]
        rets = [np.log(b / a) for a, b in zip(h, h[1:]) if a > 0 and b > 0]
        if h[-1] <= 0 or len(rets) < 3:
            assert i not in got
            continue
        seen += 1
        r = got[i]
        assert (r.threshold, r.n_rets, r.y) == (ys[i], len(rets), float(ys[i + 2] >= ys[i]))
        assert np.allclose([r.mu, r.sigma, r.last, r.accel, r.drawdown], [np.mean(rets), max(0.02, np.std(rets, ddof=1)), rets[-1], np.mean(rets[-3:]) - np.mean(rets), (h[-1] - max(h)) / max(h)])
    assert seen > 20 and len(got) == seen


def test_one_gather_for_several_origins(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(s, float(x), 5 + 0.1 * x + rng.gauss(0, 1) + (20 if s == "b" and x > 25 else 0)) for s in "ab" for x in range(40)], "series_id string, x double, y double")
    got = {(r.series_id, r.origin): (r.n, round(r.surprise, 9), r.fired) for r in series.detect_at(points, ["series_id"], {1: 20, 2: 33, 3: 5}).collect()}
    for o, upto in ((1, 20), (2, 33)):
        for r in series.detect(points.filter(F.col("x") <= upto), ["series_id"]).collect():
            assert got[r.series_id, o] == (r.n, round(r.surprise, 9), r.fired)
    assert len(got) == 4 and got["b", 2][2]
