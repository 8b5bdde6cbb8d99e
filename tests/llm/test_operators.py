"""The ten training-data operators: edge rows, brute force, round trips, held-out accuracy."""

import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, lang_id, learned_ann, lm_score, matroska, mixing, ngram_jaccard, packing, range_coder, token_files, toxicity
from tidemark.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, slice int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, rows, schema=DOCS):
    """(doc_id, text, lang, source) rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, 7, 0.5, 3) for r in rows], schema)


def edge_rows():
    rng = random.Random(4)
    long = " ".join(rng.choice(WORDS) for _ in range(30000))
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(200))
    near = base.replace(base.split()[100], "changed", 1)
    return [(0, None, None, None), (1, "", "en", "a"), (2, "  \t\n", "en", "a"), (3, "one", "en", "a"), (4, long, "en", "a"), (5, base, "en", "b"), (6, base, "en", "b"), (7, near, "en", None), (8, "a b c d", "en", "c"), (9, "a b c d", "de", "c"), (9, "a b c d", "de", "c"), (None, "lost id words here now", "en", "a")]


@pytest.fixture(scope="module")
def edges(spark):
    return docs(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# --- 1
def test_coder_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 4096, 77)] + [np.minimum(rng.zipf(1.4, 3000), 65535), np.zeros(500, int)]
    coded = range_coder.encode(blocks)
    for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True):
        assert (a == b).all()
    assert (range_coder.decode(coded[2:3], [4096])[0] == blocks[2]).all()  # a block decodes alone
    bad = bytearray(coded[2])
    bad[50] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode([bytes(bad)], [4096])
    with pytest.raises(ValueError):
        range_coder.encode([np.array([1 << 16])])


def test_coder_time_and_size():
    rng = np.random.default_rng(2)
    few = np.sort(rng.choice(40000, 600, replace=False))
    blocks = [few[np.minimum(rng.zipf(1.3, 1024) - 1, 599)] for _ in range(1024)]
    start = time.process_time()
    np.argsort(rng.random(1 << 20))
    sorting, start = time.process_time() - start, time.process_time()
    coded = range_coder.encode(blocks)
    for a, b in zip(blocks, range_coder.decode(coded, [1024] * 1024), strict=True):
        assert (a == b).all()
    assert time.process_time() - start < 16 * sorting  # for as many ids as were sorted
    assert sum(map(len, coded)) < sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_coder_refuses_broken_blocks_without_other_errors():
    rng = np.random.default_rng(3)
    coded = range_coder.encode([np.minimum(rng.zipf(1.3, 4096), 65535)])[0]
    for at in rng.integers(4, len(coded) // 2, 20):
        bad = bytearray(coded)
        bad[at] ^= 1 << int(rng.integers(8))
        with pytest.raises(ValueError):
            range_coder.decode([bytes(bad)], [4096])


def test_words_share_the_ids_of_their_letters():
    import public_tokenizers

    words = token_files.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Straße, straße; ÉTÉ!! été? ÿ ×a÷ naïve...", "hello world", "Hello, WORLD!! (world) hello's 'hello' hello', wor1d x<|endoftext|> a<b> e\u0301t\u00e9, \u0130x, \u03a3\u03a3. \ufb01x \u00aa \u00b5m \x7f, -- ... ''.", None, ""]
    ids, n = words.encode(pa.array(texts, pa.large_string()))
    want = [words.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    asked = []
    add = words._add_letters
    words._add_letters = lambda some: (asked.extend(some), add(some))
    words.encode(pa.array(["HELLO!? wOrld; Naïve, planet. Planet PLANET?"], pa.large_string()))
    assert asked == ["planet"]


def test_token_files_equal_whole_text_encoding(spark, edges, empty):
    import public_tokenizers

    name = public_tokenizers.path("word_bpe_49k.json")
    tok = token_files.tokenizer(name)
    odd = [(10, "a<|endoftext|>b <|startoftext|> don't I'M É́ x y ١٢", "en", "a"), (11, "Straße ΑΣ ΟΔΟΣ", "en", "a")]
    every = edges.unionByName(docs(spark, odd))
    path = shared_dir(spark)
    token_files.write_tokens(every, path, name)
    got = sorted(token_files.describe(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(every.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert len(got) == len(rows)
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(spark, path).filter("doc_id = 3").first().ids[-1] == 1
    path = shared_dir(spark)
    token_files.write_tokens(empty, path, name)
    assert token_files.describe(spark, path).count() == 0


# --- 2
def test_bounds_are_optimal():
    import itertools

    rng = random.Random(2)
    for _ in range(30):
        tops = sorted(rng.sample(range(1, 60), 7))
        bins = [(t, n, n * t) for t in tops for n in [rng.randrange(1, 9)]]
        cost = lambda bounds: sum((min(b for b in bounds if b >= t) - t) * n for t, n, _ in bins)
        for k in (1, 2, 3):
            best = min(cost((*c, tops[-1])) for m in range(k) for c in itertools.combinations(tops[:-1], m))
            assert cost(packing.bucket_bounds(bins, k)) == best
    assert packing.bucket_bounds([], 3) == []


def test_packing_fills_batches(spark, edges, empty):
    rows = packing.pack(edges, budget=1024).collect()
    assert len(rows) == edges.count()
    seen = {}
    for r in rows:
        assert r.length <= r.bucket_len
        seen.setdefault((r.bucket, r.batch), []).append(r)
    for (_, batch), own in seen.items():
        per = max(1, 1024 // max(1, own[0].bucket_len))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= per
    assert packing.pack(empty).count() == 0


# --- 3
def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (None, x[0].tolist()), (5080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("part", F.lit("x"))
    got = {}
    for r in learned_ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    d, hits = x.astype(float), 0
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1500), -np.round(s, 9)))[:20].tolist()))
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21)) and q not in {v for _, v, _ in found}
    assert hits / (20 * len(got)) >= 0.9
    longer = int((d @ d[100] > d[100] @ d[100]).sum())  # other vectors whose inner product is above that of the equal ones
    assert [v for _, v, _ in sorted(got[100])][longer:] == list(range(101, 121 - longer))
    assert learned_ann.nearest(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in learned_ann.nearest(two).collect()] == [(0, 1, 0.5)]


# --- 4
@pytest.mark.parametrize("n", [64, 1024, 1088, 8192, 8256, 140000])
def test_media_round_trip(n):
    x = os.urandom(n)
    data = matroska.pcm_file(x)
    m = matroska.parse(data)
    assert b"".join(data[o : o + s] for o, s in zip(m.offset, m.size, strict=True)) == x
    assert m.tracks == [(1, 2, "A_PCM/INT/LIT")] and {c[2] for c in m.cues} == set(m.cluster)


@pytest.mark.parametrize(("kind", "sizes"), [(0, [7]), (1, [300, 5, 700, 2]), (2, [9, 9, 9]), (3, [300, 5, 700, 2])])
def test_lacing(spark, kind, sizes):
    frames = [os.urandom(k) for k in sizes]
    block = matroska.simple_block(2, -5, frames, kind)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x01\x00xy") + matroska.element(matroska.REFERENCE, b"\xff"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska._number(matroska.TIMESTAMP, 100) + block + group  # size unknown
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    df = spark.createDataFrame([(1, data), (2, None), (3, b"\x00junk"), (4, b"")], "media_id long, data binary")
    rows = sorted((r for r in matroska.packets(df).collect() if r.media_id == 1), key=lambda r: r.packet)
    assert [data[r.offset : r.offset + r.size] for r in rows] == [*frames, b"xy"]
    assert rows[0].timestamp_ns == 95_000_000 and rows[-1].timestamp_ns == 101_000_000 and not rows[-1].keyframe
    bad = matroska.packets(df).filter("media_id <> 1").collect()
    assert [r.media_id for r in bad] == [3] and bad[0].error


def test_media_of_texts(spark, edges, empty):
    import hashlib

    got = matroska.describe(matroska.text_media(edges)).collect()
    want = sorted(hashlib.sha256(matroska.payload(r.text)[1]).hexdigest() for r in edges.collect())
    assert sorted(r.payload_sha256 for r in got) == want
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in got)
    assert matroska.describe(matroska.text_media(empty)).count() == 0


# --- 5
def test_mix_targets_and_bounds(spark, edges, empty):
    rows = mixing.systematic_mix(edges).collect()
    assert len(rows) == edges.count() and all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 * total
    for own in by.values():
        assert own[0].target <= 2 * own[0].source_size and own[0].source_size == sum(r.size for r in own)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.systematic_mix(edges).collect()), key=str)
    copies = mixing.mixed(edges)
    assert copies.columns == edges.columns and copies.count() == sum(r.copies for r in rows)
    assert mixing.systematic_mix(empty).count() == 0


def test_mix_hits_targets(spark):
    rng = random.Random(8)
    df = docs(spark, [(i, "w " * rng.randrange(1, 200), "en", rng.choice(["a", "b", "c", None, "d"])) for i in range(2000)])
    got = mixing.systematic_mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 400 for r in got)


# --- 6
def test_restores_obfuscation():
    text = " ".join(WORDS * 3 + ["the idiot and moron were stupid losers of trash in pathetic worthless scum clown disgusting"] * 20).encode()
    x = toxicity._KIND[np.frombuffer(text, np.uint8)]
    costs = toxicity.char_costs(np.bincount((x[:-2] * 27 + x[1:-1]) * 27 + x[2:], minlength=27**3).astype(float))
    for token, want in {"1d10t": "idiot", "i d i o t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "p@thetic": "pathetic", "w-o-r-t-h-l-e-s-s": "worthless", "clown": "clown"}.items():
        assert toxicity.restore(token, costs) == want
    data, offsets = np.frombuffer(b"plain words here i d i o t x1y don't", np.uint8), np.array([0, 36])
    assert [t for _, t in toxicity.suspects(data, offsets)] == [b"x1y", b"i d i o t"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("$cum.", "scum"), ("@sshole!", "asshole"), ("$crub$", "scrub"), ("\"$crub$!\"", "scrub"), ("!diot", "idiot"), ("\u00a3oser", "loser"), ("t r 4 s h", "trash"), ("i d 1 o t .", "idiot"), ("a m o r o n", "moron"), ("m\no\tr  o n", "moron")],
)
def test_gate_lets_edges_and_spaced_leet_through(text, want):
    corpus = " ".join(["the idiot and a moron were losers or a loser in trash like worthless scum and an asshole in a scrub"] * 20).encode()
    x = toxicity._KIND[np.frombuffer(corpus, np.uint8)]
    costs = toxicity.char_costs(np.bincount((x[:-2] * 27 + x[1:-1]) * 27 + x[2:], minlength=27**3).astype(float))
    whole = f"before {text} after"
    data = np.frombuffer(whole.encode(), np.uint8)
    assert want in toxicity.Restorer(costs).added(data, np.array([0, len(data)]))[0].split()
    table = np.frombuffer(b"rows 1 2 3 4 in 1990 (see) -- end. 'so'", np.uint8)
    assert toxicity.suspects(table, np.array([0, len(table)])) == []


def test_toxicity_on_planted_rows(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(40)] = ["idiot", "moron", "1diot", "m0ron", "i d i o t"][i // 5 % 5]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(bad)))
    d = docs(spark, [*rows, (900, None, None, None), (901, "", None, None)])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[900].score <= 1
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(600) if i % 5}
    none = toxicity.fit(empty, lab.limit(0))
    assert toxicity.score(empty, none).count() == 0


def test_character_model_does_not_depend_on_partitions(spark):
    rows = [(i, t) for i, t in enumerate(["ab", "cd", None, "", "e", "abcdef", "xyz" * 40] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = np.zeros(toxicity.LETTERS**3)
    for _, t in rows:
        x = [ord(c) - 97 for c in t or ""]
        for k in range(len(x) - 2):
            want[(x[k] * 27 + x[k + 1]) * 27 + x[k + 2]] += 1
    for n in (1, 7, 50):
        assert (toxicity.char_counts(df.repartition(n)) == want).all()


def test_weights_follow_rates_and_the_curve_fits():
    w = toxicity._weights(np.array([200.0, 4.0, 0.0]), np.array([396.0, 396.0, 50.0]), 400, 39600)
    assert abs(w[0] - np.log(50)) < 0.1 and w[1] == w[2] == 0  # half of the toxic rows against 1 % of the clean ones
    x = np.arange(13) + 0.5
    toxic = np.array([15.0, 0, 0, 1, 4, 4, 11, 28, 55, 33, 5, 14, 114])
    clean = np.array([2502.0, 115, 106, 31, 25, 15, 7, 2, 0, 0, 0, 0, 0])
    x[0] = 0
    slope, shift = toxicity._logistic(x, toxic, toxic + clean)
    s = 1 / (1 + np.exp(-slope * x - shift))
    assert abs((s * (toxic + clean) - toxic).sum()) < 0.1 and 5 < -shift / slope < 7  # whole Newton steps swing: half at 2.7


# --- 7
def brute_components(rows):
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_by_brute_force(spark):
    rng = random.Random(7)
    rows, passage = [], " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(70))
    for i in range(420):
        n = rng.choice([3, 6, 8, 12, 30, 60, 70, 100, 140, 300, 700])
        words = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)]
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + "new" + str(rng.randrange(999))
        if rng.random() < 0.2:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_every_linked_pair_shares_enough_keys():
    rng = np.random.default_rng(9)
    for n in (5, 9, 40, 63, 64, 65, 70, 120, 128, 129, 250, 500, 513, 1000, 1025, 3000):
        for _ in range(6):
            u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            m = int(n * rng.uniform(0, 0.1))
            v = np.unique(np.concatenate([u[rng.permutation(len(u))[m:]], rng.integers(0, 1 << 63, int(m * rng.uniform(0, 1.2))).astype(np.uint64)]))
            if ngram_jaccard.linked(len(np.intersect1d(u, v)), len(u), len(v)):
                (a, need_a, sure_a), (b, need_b, sure_b) = ngram_jaccard.join_keys(u), ngram_jaccard.join_keys(v)
                shared = len(np.intersect1d(a, b))
                if sure_a and sure_b:
                    assert shared >= max(need_a, need_b)


def test_jaccard_edges(spark, edges, empty):
    got = {}
    for r in ngram_jaccard.jaccard_components(edges).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[0] == [(0, 0)] and got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(1, 3)]
    assert got[6][0][1] == 5 and got[7][0][1] == 5 and got[9] == [(1, 8), (1, 8)] and got[None] == [(1, None)]
    kept = ngram_jaccard.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(120)) for _ in range(2))
    near = a.replace(a.split()[60], "changed", 1)
    rows = [(1, a), (2, near), (2, b), (3, b), (4, a), (None, a), (5, None), (5, None), (6, " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, own int")
    for d in (df, df.orderBy(F.desc("text"))):
        got = ngram_jaccard.keep_one(d)
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
        assert got.columns == df.columns and sum(t in (a, near) for n, _, t in kept if not n) == 1 and sum(t == b for *_, t in kept) == 1
        assert [(i, t) for n, i, t in kept if i in (5, 6)] == [(5, ""), (6, " ")] and any(n for n, *_ in kept)
    assert ngram_jaccard.keep_one(df.limit(0)).count() == 0


def test_copies_far_from_the_smallest_id(spark):
    """Copies of a base that differ from each other by more than the limit, the base having the largest id."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(300)]
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    rows.append((99, " ".join(base)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(set(want.values())) < 41


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 60, 3):
        base = [[rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n)] for n in (300, 200, 40)]
        near = [" ".join(["new", *w[1:]]) for w in base]
        rows += [(i + 100, " ".join(w)) for w in base] + [(i + 100, "")] + [(i + 101, near[0]), (i + 2, near[1]), (i + 1, near[2]), (i + 102, " ".join(base[2][:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.class_id) for r in ngram_jaccard.jaccard_components(df).collect())
    size = lambda text: len({tuple(text.split()[k : k + 5]) for k in range(len(text.split()) - 4)})
    linked = {i + k: i + 1 for i in range(0, 60, 3) for k in (1, 2, 100, 101)}
    assert got == sorted((i, size(text), linked.get(i, i), i) for i, text in rows)
    kept = ngram_jaccard.keep_one(df).collect()
    # Different texts of one id are different documents: of three groups the least id, the empty text and the lone one stay.
    assert sorted(r.doc_id for r in kept) == sorted(i + k for i in range(0, 60, 3) for k in (1, 2, 100, 100, 102))
    texts = dict(((i, len(t.split())), t) for i, t in rows)
    assert all(r.text == texts[r.doc_id, len(r.text.split())] for r in kept)


# --- 8
def test_languages_of_held_out_rows(spark, edges, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and np.mean([r.rejected for r in got]) < 0.02
    model = lang_id.fit(lang_id.training_rows(d))
    rows = {r.doc_id: r for r in lang_id.identify(docs(spark, [(0, None, None, None), (1, "", None, None), (2, "123 !!", None, None), (3, "the of and that with this", None, None)]), model).collect()}
    assert [rows[k].lang_pred for k in range(3)] == ["und"] * 3 and rows[3].lang_pred == "en"
    assert lang_id.keep_known(edges, model).columns == edges.columns
    assert lang_id.identify(empty).count() == 0


# --- 9
def test_html_blocks(spark):
    good = " ".join(["the story of a town and its river was told by the people that lived in it"] * 3)
    page = f"""<html><head><title>x</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=a>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site and the like of it for you and for us</div>
    <article><h1>Title &amp; more</h1><p><b>{good}<br>caf&eacute;</b><p>Short.</p><div class="ad">buy the best of it now and for all the people</div></article>
    <div class="comments"><p>{good}</p></div><footer>&copy; the site</footer></body>"""
    want = f"Title & more\n\n{good} café\n\nShort."
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", "<p>", 4), (None, "u", "<article>x < y", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""] and got[None].text == "x < y"
    plain = f"<div><div>Menu</div><div><p>{good}</p><p>And so on.</p></div></div>"
    assert html_text.main_text(plain).startswith(good) or good in html_text.main_text(plain)


@pytest.mark.parametrize("open_", ['<body class="has-sidebar"><article>', '<body class="nav-open"><main>', '<main class="content with-sidebar">', '<div class="legal-news"><article>', '<div class="comments"><main>', '<div class="sidebar"><article class="notice">', '<html class="menu"><body id="search"><div class="modal-open">'])
def test_names_of_wrappers_keep_the_article(open_):
    good = " ".join(["the story of a town and its river was told by the people that lived in it"] * 3)
    bad = f'<div class="sidebar"><p>{good} bad</p></div><div class="main-nav x">{good} bad</div><div class=related><article>{good} bad</article></div>'
    assert html_text.main_text(f"{open_}<h1>Title</h1><p>{good}</p>") == f"Title\n\n{good}"
    assert html_text.main_text(f"<body><article><p>{good}</p></article>{bad}</body>") == good
    assert html_text.main_text(f'<div class="comments"><article class="comment-body">{good}</article></div><nav><main>{good}</main></nav>') == ""


def test_markup_that_is_broken():
    good = " ".join(["the story of a town and its river was told by the people that lived in it"] * 3)
    assert html_text.main_text(f"<body class='single no-sidebar'><p title=don't>{good}</p><p>It isn't.</p>") == f"{good}\n\nIt isn't."
    assert html_text.main_text(f"<article><button>x<p>{good}</p><svg><select><p>{good} too</p></article>") == f"x\n\n{good}\n\n{good} too"
    assert html_text.main_text(f'<article><p class="a>{good}</p><p>{good}</p></article>') == f"{good}\n\n{good}"
    block = "un bloc de quarante mots en catalana llengua que cap llista coneix i que tanmateix val tant com qualsevol altre".split()
    assert html_text.main_text(f"<body><div><p>{' '.join(block * 2)}</p></div></body>") == " ".join(block * 2)


@pytest.mark.parametrize("piece", ['<a "', "<svg>", "<!", "</ ", "<p class='x", "<", "<b>x</b> "])
def test_long_pages_take_linear_time(piece):
    import time

    took = []
    for size in (500_000, 2_000_000):
        page = piece * (size // len(piece))
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


@pytest.mark.parametrize(
    "text",
    [
        "Это история маленького города и его реки, которую рассказали люди, жившие здесь много лет тому назад.",
        "Historia małego miasta i jego rzeki, którą opowiedzieli ludzie mieszkający tam przez wiele długich lat.",
        "这是一个关于小镇和河流的故事，由多年以前住在那里的人们讲述，至今仍然有人记得。",
        "これは小さな町とその川の物語であり、昔そこに住んでいた人々によって語られたものです。",
    ],
)
def test_main_text_in_other_languages(text):
    menu = "<nav><a href=a>Home</a></nav><div><a href=b>One</a> <a href=c>Two</a></div>"
    assert html_text.main_text(f"<body>{menu}<div><p>{text}</p><p>{text}</p></div><footer>x</footer></body>") == f"{text}\n\n{text}"
    assert html_text.main_text(f"<body><div class=menu><p>{text}</p></div><p><a href=a>{text}</a></p></body>") == ""


# --- 10
def test_scores_by_brute_force(spark, edges, empty):
    import collections
    import math

    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, "Alpha never-seen")]
    texts = {i: (t or "").lower().split() for i, t in rows}
    count = lambda w: collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    own = {i: count(w) for i, w in texts.items()}
    every = sum(own.values(), collections.Counter())
    total = sum(map(len, texts.values()))
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, w in texts.items():
        c = lambda g: every[g] - own[i][g]  # noqa: B023, E731
        micro, used = 0, collections.Counter()
        for k in range(len(w)):
            top = min(3, k + 1)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if c(g) > 0 or n == 1:
                    value = (c(g) / c(g[:-1]) if n > 1 else max(c(g), 0.5) / max(total - len(w), 1)) * 0.4 ** (top - n)
                    used[n if c(g) > 0 else 0] += 1
                    break
            micro += math.floor(math.log(value) * 1e6 + 0.5)
        r = got[i]
        assert r.n_words == len(w) and abs(r.log_micro - micro) <= len(w) and [r[f"by_order_{n}"] for n in range(4)] == [used[n] for n in range(4)]
    assert got[60].score is None
    assert lm_score.score(edges).count() == edges.count() and lm_score.score(empty).count() == 0
