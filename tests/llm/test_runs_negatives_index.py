"""Periodic runs, hard negatives and decontamination against brute force, with edge rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate, hard_negatives, periodic
from tidemark.llm.shared import mix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs int, words string, key string, pos int, x int, item int, w string"


def docs(spark, rows):
    """(doc_id, text) rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, "w", "k", 2, 3, 4, "z") for r in rows], DOCS)


# --- 11
def brute_runs(t, least=24, copies=3):
    """All (start, length, period), by comparing every word with those at every distance."""
    out = []
    for q in range(1, len(t) // copies + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, copies * q) and not any(all(t[k] == t[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words_of(rng):
    kind, sigma, n = rng.randrange(6), rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 150)
    if kind == 0:
        return [rng.randrange(sigma) for _ in range(n)]
    if kind == 1:
        u = [rng.randrange(sigma) for _ in range(rng.randrange(1, 40))]
        return [rng.randrange(9) for _ in range(rng.randrange(20))] + (u * 100)[:n] + [rng.randrange(9) for _ in range(rng.randrange(20))]
    if kind == 2:
        return fibonacci(n)
    if kind == 3:
        u = ([0] * rng.randrange(1, 20) + [1]) * rng.randrange(3, 5)
        return (u + [2] + u + [2] + u + [2] + u)[:300]
    if kind == 4:
        t = []
        while len(t) < n:
            t += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 6)
        return t
    return [rng.randrange(50) for _ in range(n)]


def test_runs_by_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = [words_of(rng) for _ in range(rng.randrange(1, 5))]
        rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        hashes = mix(np.array([w + 1 for t in texts for w in t], np.uint64))
        start, length, period = periodic.find_runs(hashes, rows)
        want = sorted(((a + int(o), b, c) for t, o in zip(texts, rows[:-1], strict=True) for a, b, c in brute_runs(t)), key=lambda r: (r[0], r[2]))
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_the_vocabulary_holds_every_distinct_square():
    rng = random.Random(12)
    for _ in range(60):
        t = words_of(rng)[:70] + [99]
        n = len(t)
        f = periodic.Factors(np.array(t), np.zeros(n, np.int64), np.full(n, n))
        order = f.order
        common = np.concatenate([[0], f.forward(np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:]))])
        cut = np.array(periodic.blocks(order.tolist(), common.tolist()))
        # Each block is the longest stretch that also begins earlier.
        for a, b in itertools.pairwise(cut.tolist()):
            longest = max((next((k for k in range(n - a) if t[e + k] != t[a + k]), n - a) for e in range(a)), default=0)
            assert b - a == max(1, longest)
        start, period = periodic.covering(f, cut[:-1], cut[1:], np.append(cut[2:], n), np.zeros(len(cut) - 1, np.int64), np.full(len(cut) - 1, n))
        squares = {}
        for s, p in set(zip(start.tolist(), period.tolist(), strict=True)):
            assert t[s : s + p] == t[s + p : s + 2 * p]
            squares.setdefault(s, []).append(2 * p)
        _, dense = np.unique(t, return_inverse=True)
        tree = periodic.Tree(dense.tolist(), order.tolist(), common.tolist())
        got = [tuple(t[order[tree.low[v]] : order[tree.low[v]] + k]) for v, k in tree.vocabulary(tree.located(squares))]
        assert len(got) == len(set(got))
        assert set(got) == {tuple(t[i : i + 2 * p]) for i in range(n) for p in range(1, n) if i + 2 * p <= n and t[i : i + p] == t[i + p : i + 2 * p]}


def expected_11(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op11_by_brute_force(spark, tmp_path):
    rng = random.Random(13)
    rows = [(None, None), (None, "a " * 40), (1, ""), (2, " \t\n"), (3, "one"), (4, "ab " * 23), (5, "ab " * 24), (5, "ab " * 24), (5, "É é " * 30), (6, "A a " * 20 + "a " * 30)]
    rows += [(k, " ".join(str(x) for x in words_of(rng))) for k in range(100, 220)]
    rows += [(900, " ".join(str(k % 977) for k in range(6000)))]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:8] for r in periodic.op11(spark, str(tmp_path)).collect()]
    order = lambda r: tuple(map(str, r))
    want = sorted((expected_11(*r) for r in rows[:-1]), key=order)
    assert sorted((r for r in got if r[0] != 900), key=order) == want
    assert [r[1:5] for r in got if r[0] == 900] == [(1, 0, 6000, 977)]
    assert sum(r[1] > 0 for r in got) > 20
    assert periodic.periodic_runs(docs(spark, [])).count() == 0


def test_op11_on_the_table_by_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(r.doc_id, r.text) for r in d.collect() if r.text is None or len(r.text) < 3000]
    got = {r[0]: tuple(r)[:8] for r in periodic.op11(spark, SF).collect()}
    assert len(got) == d.count() and all(got[i] == expected_11(i, t) for i, t in short)


# --- 12
def expected_12(rows, every=100, k=5):
    ok = [(i, label, [math.floor(256 * np.float64(x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for *_, v in ok]
    common = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    ok = [r for r in ok if len(r[2]) == common]
    out = []
    for a, (i, label, v) in enumerate(ok):
        if i % every == 0:
            scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, other, w) in enumerate(ok) if b != a]
            for s, p, _ in sorted(t for t in scored if t[2] == label)[:k]:
                near = sorted(t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)[:k]
                out += [(i, p, r + 1, j, -s, -n) for r, (n, j, _) in enumerate(near)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2.0) for r in rows], "vec_id long, label int, embedding array<float>, block int, place string, score double")


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[50:250] = x[50]  # a common vector: ties
    rows = [(int(i), int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    rows += [(100, 1, x[3].tolist()), (100, 1, x[3].tolist()), (300, None, x[1].tolist()), (None, 1, x[2].tolist()), (800, 2, None), (801, 2, [float("nan")] * 8), (802, 2, [None] * 8), (900, 2, [0.0] * 8), (1000, 1, [1.0]), (1100, 1, [float("inf")] * 8), (1200, 77, x[9].tolist())]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors(spark, rows).repartition(5)).collect())
    assert got == expected_12(rows) and len(got) > 50
    assert hard_negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0]), (2, 1, [1.0])])).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(vectors(spark, [(100, 1, [1e30])]))


def test_planes_hold_the_numbers():
    x = np.array([[-256, 255, 0], [7, -8, 256]])
    block = hard_negatives.pack(np.array([1, 2]), np.array([0, 1]), x)
    bits = hard_negatives.planes(block, 3)
    assert (sum(bits[k].astype(int) << (block["width"] - 1 - k) for k in range(block["width"])) + block["low"] == x).all()
    same = hard_negatives.pack(np.array([1]), np.array([0]), np.full((1, 3), -5))
    assert same["width"] == 0 and hard_negatives.planes(same, 3).shape == (0, 1, 3)


# --- 13
def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_13(rows, items, window=10):
    out = []
    for i, text in rows:
        w, hit, ids = tokens(text), set(), set()
        for item, own in items:
            t = tokens(own)
            n = min(window, len(t))
            if item is not None and n:
                wins = {tuple(t[s : s + n]) for s in range(len(t) - n + 1)}
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) in wins:
                        hit |= set(range(s, s + n))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def passages(rng):
    vocab = [f"w{k}" for k in range(30)] + ["É", "naïve", "2024"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 25, 40])))) for k in range(30)] + [(3, "a a a a a a a a a a a a"), (40, ""), (41, None), (None, "w1 w2"), (5, "Rare-Word one/two"), (5, "Rare-Word one/two")]
    rows = [(None, None), (None, "w1"), (1, ""), (2, " . ,"), (3, "a " * 500), (4, "RARE word, ONE! two"), (4, "rare\tword\none two"), (4, "rare word one two")]
    for k in range(10, 60):
        parts = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            own = tokens(rng.choice(items)[1])
            a = rng.randrange(0, len(own) + 1)
            parts += own[a : a + rng.choice([9, 10, 30])] + [rng.choice(vocab)]
        rows.append((k, " ".join(p.upper() if rng.random() < 0.2 and p.isascii() else p for p in parts)))
    return rows, items


def test_contamination_by_brute_force(spark, monkeypatch):
    rows, items = passages(random.Random(14))
    bench = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in items], "item_id long, text string, doc_id int, term string, j string")
    want = expected_13(rows, items)
    run = lambda r, b: sorted(((x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in decontaminate.contamination(r, b).collect()), key=str)
    assert run(docs(spark, rows).repartition(4), bench) == want and sum(r[2] > 0 for r in want) > 20
    monkeypatch.setattr(decontaminate, "SMALL", 0)  # nothing is broadcast
    monkeypatch.setattr(decontaminate.small, "__defaults__", (0,))
    assert run(docs(spark, rows), bench) == want
    assert run(docs(spark, []), bench) == [] and all(r[2] == 0 for r in run(docs(spark, rows[:5]), bench.limit(0)))


def test_phrases_and_places_nearby(spark):
    rng = random.Random(15)
    vocab = [f"v{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(80))) for k in range(20)]
    items = [(1, "v1 v2 v3"), (2, "v4"), (3, "v5 v5 v6"), (4, "v1 v1 v1 v1"), (5, "v7 missing")]
    terms = decontaminate.terms_of(spark.createDataFrame(items, "item_id long, text string"))
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    key = {r.key: r.doc_id for r in decontaminate.headers(index).collect()}
    got = {(key[r.key], r.item_id, r.first - 1, r["last"] - 1) for r in decontaminate.phrase_matches(index, terms, 2).collect()}
    want = set()
    for i, text in rows:
        w = text.split()
        for item, own in items:
            t = own.split()
            for a in range(len(w)):
                for j in range(len(t)):
                    n = 0
                    while a + n < len(w) and j + n < len(t) and w[a + n] == t[j + n]:
                        n += 1
                    if n >= min(2, len(t)) and not (a and j and w[a - 1] == t[j - 1]):
                        want.add((i, str(item), a, a + n - 1))
    assert got == want and want
    span = 6
    near = {(key[r.key], r.item_id, r.first - 1, r["last"] - 1) for r in decontaminate.proximity_matches(index, terms, span).collect()}
    counts = {v: sum(t.split().count(v) for _, t in rows) for v in [*vocab, "missing"]}
    want = set()
    for i, text in rows:
        w = text.split()
        for item, own in items:
            need = set(own.split())
            rare = min(need, key=lambda v: (counts[v], v))
            for at in (k for k in range(len(w)) if w[k] == rare):
                fits = [(b - a, a) for a in range(max(0, at - span + 1), at + 1) for b in range(at, min(len(w), a + span)) if need <= set(w[a : b + 1]) and w[a] in need]
                if fits:
                    wide, a = min(fits)
                    want.add((i, str(item), a, a + wide))
    assert near == want and want


def test_plan_of_the_index_has_no_python(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontaminate.contamination(d, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
