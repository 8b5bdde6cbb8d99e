"""Edge rows of the pipeline's stages, names that clash, names inside articles, ids with several vectors."""

import itertools
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, lang_id, learned_ann, matroska, mixing, packing, shared, toxicity

SF = "/root/testdata/sf0.001"
#: A table's own columns by the names that operators use.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, found int, nth string, size long, copy int, own string, slice int, key string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, None, 9, "nth", 8, 7, "own", 3, "k") for r in rows], CLASH)


def edge_rows(spark):
    own = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    long = " ".join(t for _, t, _, _ in own[:20]) * 8
    return [*own, (None, None, None, None), (None, own[0][1], None, None), (900, None, "en", "a"), (901, "", "en", "a"), (902, " \t\n", "en", "a"), (903, long, own[0][2], "a"), *[(904, own[1][1], own[1][2], "b")] * 3, (904, own[2][1], own[2][2], "b"), (905, "12 34 !!", "en", "a")]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_edge_rows(spark, k):
    rows = clashing(spark, edge_rows(spark))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, rows, SF)
    assert out.columns == rows.columns
    got = out.collect()
    assert got and all((r.found, r.nth, r.size, r.copy, r.own, r.slice, r.key) == (9, "nth", 8, 7, "own", 3, "k") for r in got)
    known = {(r.doc_id, r.text) for r in rows.collect()}
    assert {(r.doc_id, r.text) for r in got} <= known
    again = stage(spark, rows.repartition(5), SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)), name
    assert stage(spark, rows.limit(0), SF).collect() == []


def test_pipeline_packs_edge_rows(spark):
    rows = clashing(spark, edge_rows(spark))
    packed = corpus_pipeline.pack(spark, rows, SF)
    assert packed.count() == rows.count() and corpus_pipeline.pack(spark, rows.limit(0), SF).count() == 0


def test_the_text_with_the_extra_copy_is_the_same_in_every_run(spark):
    rows = [(1, f"word{k} other", "en", "a") for k in range(7)] + [(None, "x y", None, None)] * 5
    df = clashing(spark, rows)
    runs = [sorted(str(r) for r in mixing.mixed(df.repartition(n)).collect()) for n in (1, 3, 6)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 12


def test_exact_bounds_with_all_bits(spark):
    rng = random.Random(3)
    lengths = [rng.choice([129, 130, 131, 515, 518, 1023, 1029, 4100, 4111]) for _ in range(60)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, n int")
    got = {r.bucket_len for r in packing.pack(df, F.col("n"), buckets=3, bits=63).collect()}
    tops = sorted(set(lengths))
    cost = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths)
    assert cost(got) == min(cost((*c, tops[-1])) for m in (0, 1, 2) for c in itertools.combinations(tops[:-1], m))


def test_long_texts_teach_their_language(spark):
    long = "uno dos tres perro gato casa " * 20000
    rows = [(i, long if i % 2 else "the house and the dog of the town", "es" if i % 2 else "en", "a") for i in range(40)]
    got = lang_id.training_rows(clashing(spark, rows))
    assert {lang for _, lang in got} == {"es", "en"} and sum(len(t) for t, _ in got) <= lang_id.FIT_CHARS
    assert toxicity.keep_clean.__doc__ and lang_id.keep_known.__doc__


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_an_id_with_several_vectors_is_one_item(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6))
    rows = [(int(i % 90), v.tolist()) for i, v in enumerate(x)]  # ids 0 to 89, three or four vectors each
    got = {}
    for r in learned_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {}
    for q in range(0, 90, 20):
        best = {j: max(float(a @ b) for (i, _), a in zip(rows, x, strict=True) if i == q for (k, _), b in zip(rows, x, strict=True) if k == j) for j in range(90) if j != q}
        want[q] = [(n + 1, j, round(s, 9)) for n, (j, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5])]
    assert {q: sorted(v) for q, v in got.items()} == want


GOOD = " ".join(["the story of a town and its river was told by the people that lived in it"] * 3)


@pytest.mark.parametrize("name", ['class="market-share"', 'id="fire-alert"', 'class="job-share"', 'class="page-banner-story"', 'class="post-with-widget"', 'class="login-history"'])
def test_a_piece_of_a_name_does_not_lose_text(name):
    page = f'<html><body><article><h1>A head</h1><div {name}><h2>Below</h2><p>{GOOD}</p><p>Short one.</p></div><p>{GOOD} end</p></article></body></html>'
    assert html_text.main_text(page) == f"A head\n\nBelow\n\n{GOOD}\n\nShort one.\n\n{GOOD} end"
    assert html_text.main_text(f"<article><div {name}>{GOOD}</div></article>") == GOOD


@pytest.mark.parametrize("piece", ['<div class="share-this-post">Share this story</div>', f'<div class="newsletter-signup">{GOOD}</div>', f'<div class="cookie-notice">{GOOD}</div>', f'<div class="comment-list"><p>{GOOD}</p></div>', '<div class="ad-banner">Buy it now</div>', f"<p hidden>{GOOD}</p>", f'<div style="display: none">{GOOD}</div>', '<div class="job-share"><a href=x>Share with a friend</a></div>'])
def test_furniture_inside_an_article_goes(piece):
    assert html_text.main_text(f"<article><p>{GOOD}</p>{piece}<p>{GOOD} end</p></article>") == f"{GOOD}\n\n{GOOD} end"


def test_quotes_with_names_stay():
    assert html_text.main_text(f'<article><p>{GOOD}</p><blockquote class="reply">{GOOD} said</blockquote></article>') == f"{GOOD}\n\n{GOOD} said"


def test_second_pass_by_a_naive_walk():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 14)
        found = []
        for _ in range(n):
            kind = rng.choice(["good", "bad", "short"])
            text = {"good": GOOD, "bad": "click", "short": "two words"}[kind]
            found.append(html_text.Block(text, kind == "bad", rng.randrange(3), rng.random() < 0.3 and kind == "short", 0))
        done = html_text.classify(found)
        for k, b in enumerate(done):
            if b.label:
                assert b.final == b.label
                continue
            near = {}
            for j, o in enumerate(done):
                if o.region == b.region and (o.label > 0 or o.label < 0 and not o.region):
                    side = j > k
                    if side not in near or abs(j - k) < abs(near[side] - k):
                        near[side] = j
            best = [(abs(j - k) - (0.5 if b.heading and side else 0), -done[j].label) for side, j in near.items()]
            assert b.final == (-min(best)[1] if best else 1 if b.region else -1)


def test_media_by_plain_arithmetic(spark):
    import hashlib
    import zlib

    texts = [(1, None), (2, ""), (3, "a" * 63), (4, "a" * 64), (5, "héé " * 5000), (6, "a" * 64), (None, "x")]
    files = matroska.text_media(spark.createDataFrame(texts, "doc_id long, text string").withColumn("data", F.lit(1)))
    data = {r.doc_id: r.data for r in files.collect()}
    for r in matroska.describe(files).collect():
        raw = (dict(texts)[r.doc_id] or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        x = [b - 128 for b in raw]
        modes = [raw.count(v) for v in range(256)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(data[r.doc_id]), hashlib.sha256(data[r.doc_id]).hexdigest())
        crossings = sum((a < 0) != (b < 0) for a, b in itertools.pairwise(x))
        assert r.feature == f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};mode={modes.index(max(modes))}"
    assert data[4] == data[6]
    odd = spark.createDataFrame([(1, 5, None), (2, 5, bytearray(data[3][: len(data[3]) // 2]))], "doc_id long, n_bytes long, data binary")
    got = {r.doc_id: r for r in matroska.describe(odd).collect()}
    assert got[1].payload_sha256 is None and got[1].media_bytes is None and got[2].feature is None and got[2].media_bytes == len(data[3]) // 2
    assert matroska.describe(odd.limit(0)).count() == 0


def test_lattices_by_enumeration():
    """The decoder's reading of small lattices costs what the cheapest of all paths costs."""
    rng = np.random.default_rng(3)
    costs = toxicity.char_costs(rng.integers(0, 50, toxicity.LETTERS**3).astype(float))
    kind = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26
    for token, end in [("1d10t", np.inf), ("h3ll0", np.inf), ("s.t.u", np.inf), ("coool", np.inf), ("f u n", 2.0), ("a$$", 4.0), ("@ b c", np.inf), ("x+y!", np.inf)]:
        best = {}
        for path in itertools.product(*toxicity._readings(token, end)):
            total, a, b = sum(extra for _, extra in path), 26, 26
            for letter, _ in path:
                if letter:
                    total, a, b = total + costs[a, b, kind(letter)], b, kind(letter)
            total += costs[a, b, 26]
            text = "".join(letter for letter, _ in path)
            best[text] = min(total, best.get(text, np.inf))
        assert abs(best[toxicity.restore(token, costs, end)] - min(best.values())) < 1e-9
