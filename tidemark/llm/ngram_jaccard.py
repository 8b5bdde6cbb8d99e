"""N-gram Jaccard join by parity sketches.

Every set gets a sketch of m parts of 64 bits; each shingle XORs its hash into one part. Two sets whose symmetric difference
is D differ in at most D parts, so the Hamming distance over parts is a lower bound of D. For Jaccard >= 0.8 and sizes a <= b
the difference is at most (a + b) / 9, and a set with more non-empty parts than that shares a non-empty part with every
partner (pigeonhole): equal parts are the join keys, per size band. A pair is joined in the band of its larger set.

Linked pairs do not just share one part but at least `need` of them (the set's non-empty parts less the greatest difference a
partner may have), so a document that shares fewer keys with other components is out without any comparison: passages that
many documents share give each of them a few common parts, not enough.

Stages, all distributed; what crosses to the driver are counts:
1. classes: documents with equal sets (size and 128-bit set hash) are linked through the smallest id; a task gives the keys of
   each of its classes once, so copies of one text do not crowd a key;
2. keys, and within each key the smallest id as its anchor: a document verifies its commonest anchor, if it shares `need` keys
   with it, so a group of n near copies costs n pairs, not n^2;
3. components of those links. Keys that hold several components are open; rounds with other anchors (the least hash of another
   seed) follow while they join a twentieth of the open documents: a group whose copies do not all resemble the first anchor
   still costs n pairs a round;
4. the documents that are open then are searched in full. Of each only as many keys are looked up, the rarest first, as
   guarantee that partners meet. Keys whose smallest component is the same are searched together, so that a pair that shares
   many keys meets once or a few times: fixed-size blocks of such a neighbourhood meet pairwise in separate tasks, a bit
   sketch's Hamming distance rejects, the rest is verified exactly;
5. components again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_int64, bounded_batches, discard, materialize, mix, shingle_sets, unused

#: Words of a shingle; the least similarity as a ratio of whole numbers.
K, NUM, DEN = 5, 80, 100
#: The largest set of the first band; the parts of that band's sketch, so many that small sets keep enough non-empty ones.
FIRST, FIRST_PARTS = 64, 4096
#: Documents of one key in a block, documents that meet one anchor in one task, and rows that are searched together.
BLOCK, FAN, SEARCHED = 256, 128, 4096
#: Rows of ids (24 bytes each) that may be broadcast; texts that are verified in one task; keys of a document, about.
ASKED, VERIFIED, KEYS = 1 << 20, 512, 300
_TRI = 0x5851F42D4C957F2D


def linked(inter, a, b):
    """100 * |A n B| >= 80 * |A u B|."""
    return DEN * inter >= NUM * (a + b - inter)


def band(n: int) -> int:
    """Bands double: [1, 64], (64, 128], (128, 256], ..."""
    return max(0, int(n - 1).bit_length() - 6)


def parts_of(k: int) -> int:
    return (FIRST << k) // 4 + 6 if k else FIRST_PARTS


def _band_keys(u: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Keys of the non-empty parts of a set's sketch under band k; how many they are."""
    part = ((u >> np.uint64(32)) * np.uint64(parts_of(k))) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    parity = np.bitwise_xor.reduceat(mix(u + np.uint64(_TRI)), first)
    return mix(parity ^ mix(part[first] + np.uint64((k + 1) << 40))), len(first)


def join_keys(u: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """The join keys of a set (sorted distinct hashes); how many of them it shares at least with any partner; whether the
    pigeonhole guarantee holds for it as a pair's larger set.

    Keys of its own band always; of the next band too if a partner (at most 1.25 times as large) can lie there."""
    n = len(u)
    if n == 0:
        return u, 0, True
    reach, k = n * DEN // NUM, band(n)
    own, filled = _band_keys(u, k)
    keys, need, sure = [own], filled - (n + min(reach, FIRST << k)) // 9, filled > 2 * n // 9
    if band(reach) > k:
        beyond, filled = _band_keys(u, k + 1)
        keys.append(beyond)
        need = min(need, filled - n // 4)
    return np.concatenate(keys), max(1, need), sure


def _set_hashes(u: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return (np.bitwise_xor.reduce(mix(u)), np.add.reduce(mix(u ^ np.uint64(_TRI)))) if len(u) else (np.uint64(0), np.uint64(0))


def _measure(batches):
    """doc_id, text -> doc_id, n_shingles, two hashes of the set, need, sure."""
    for batch in batches:
        n, h1, h2, need, sure = [], [], [], [], []
        for u in shingle_sets(batch.column(1), K):
            _, least, ok = join_keys(u)
            n.append(len(u))
            need.append(least)
            sure.append(ok)
            one, two = _set_hashes(u)
            h1.append(one)
            h2.append(two)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_int64(np.array(h1, np.uint64)), as_int64(np.array(h2, np.uint64)), pa.array(need, pa.int32()), pa.array(sure, pa.bool_())], ["doc_id", "n_shingles", "h1", "h2", "need", "sure"])


def _keys(batches):
    """doc_id, text -> doc_id, key: a row for each key of the first document of each class that the task sees (24 bytes are
    remembered for each)."""
    seen: set[bytes] = set()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own, data = [], []
        for k, u in enumerate(shingle_sets(batch.column(1), K)):
            name = b"".join(h.tobytes() for h in (*_set_hashes(u), np.int64(len(u))))
            if name not in seen:
                seen.add(name)
                own.append(ids[k])
                data.append(join_keys(u)[0])
        for i in range(0, len(data), 512):
            some = data[i : i + 512]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(own[i : i + 512]), [len(k) for k in some])), as_int64(np.concatenate(some))], ["doc_id", "key"])


def _all_shingles(batches):
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), K))
        ends = np.cumsum([0, *map(len, sets)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), as_int64(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))], ["doc_id", "keys"])


def _verify_fan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One anchor (row with doc_id = anchor) and some of its documents: the pairs that are linked."""
    sets = dict(zip(pdf["doc_id"], shingle_sets(pa.array(pdf["text"], pa.large_string()), K), strict=True))
    a = pdf["anchor"].iloc[0]
    mine = sets[a]
    out = [d for d, u in sets.items() if d != a and linked(len(np.intersect1d(mine, u, assume_unique=True)), len(mine), len(u))]
    return pd.DataFrame({"a": np.full(len(out), a, np.int64), "b": np.array(out, np.int64)})


def verified(pairs: DataFrame, texts: DataFrame, rows: int | None = None) -> DataFrame:
    """(anchor, doc_id) pairs (`rows` at most, where that is known), anchor <> doc_id -> the linked ones as (a, b), by the exact sets. An
    anchor of many documents is dealt to one task for each FAN of them. Up to ASKED rows of ids go to the texts; more are joined
    with them by a shuffle."""
    pairs = materialize(pairs.select("anchor", "doc_id").distinct(), rows)
    size = pairs.groupBy("anchor").agg(F.count("*").alias("fans"))
    dealt = pairs.join(size, "anchor").withColumn("fan", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("fans") / FAN)))
    anchors = dealt.select("anchor", "fan").distinct().withColumn("doc_id", F.col("anchor"))
    asked = materialize(dealt.select("anchor", "fan", "doc_id").unionByName(anchors), rows)
    n = asked.count()
    few = F.broadcast(asked) if n <= ASKED else asked
    got = materialize(texts.join(few, "doc_id").groupBy("anchor", "fan").applyInPandas(_verify_fan, "a long, b long"), n, VERIFIED)
    discard(pairs, asked)
    return got


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable. Large-star and small-star rounds, each written to the
    shared folder; rounds grow with the logarithm of a component's length, and a hub's edges are never gathered. rows: the most
    links, where that is known (no round has more)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, rows)
    before = None
    while True:
        # Large star: each node's larger neighbours are hung on the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours are hung on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        former, edges = edges, materialize(small, rows)
        discard(former)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _sketch_bits(u: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of `bits` bits (a multiple of 64): each shingle flips one bit."""
    return np.packbits(np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def _sketches(batches):
    """doc_id, text -> doc_id, n, sketch: a set's parity sketch, its bits the power of two above 2 n."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), K))
        out = [_sketch_bits(u, _bits(len(u))).tobytes() for u in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "sketch"])


def _bits(n: int) -> int:
    return 1 << max(9, int(2 * n).bit_length())


def _folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """A sketch brought to fewer bits: positions are hashes modulo a power of two, so halves are XORed."""
    while len(sketch) * 64 > bits:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _search_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some pairs of blocks (of one neighbourhood each): pairs of documents of different components that their sketches don't
    reject."""
    pdf = pdf.sort_values(["near", "i", "j"])
    change = (np.diff(pdf[["near", "i", "j"]].to_numpy(), axis=0) != 0).any(1)
    cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(pdf)]])
    docs, raw, size = (pdf[c].to_numpy() for c in ("doc_id", "sketch", "n"))
    comp, block, cross = pdf["component"].to_numpy(), pdf["block"].to_numpy(), (pdf["i"] != pdf["j"]).to_numpy()
    out = set()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = size[a:b]
        near = np.triu((comp[a:b, None] != comp[None, a:b]) & (DEN * np.minimum.outer(n, n) >= NUM * np.maximum.outer(n, n)), 1)
        if cross[a]:
            near &= block[a:b, None] != block[None, a:b]
        x, y = np.nonzero(near)
        if len(x):
            bits = _bits(int(n.min()))
            sk = np.stack([_folded(np.frombuffer(raw[k], np.uint64), bits) for k in range(a, b)])
            far = np.concatenate([np.bitwise_count(sk[x[k : k + 4096]] ^ sk[y[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(x), 4096)])
            ok = 9 * far <= n[x] + n[y]
            p, q = docs[a + x[ok]], docs[a + y[ok]]
            out.update(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True))
    return pd.DataFrame(list(out), columns=["anchor", "doc_id"], dtype=np.int64)


def _open(rows: DataFrame, need: DataFrame, seed: int, about: int) -> DataFrame:
    """(key, doc_id, component) -> those of keys that hold several components, for documents with at least `need` such keys,
    with the key's anchor under a seed and the anchor's component. Aggregated before the shuffle, and joined: a common key's
    rows need not lie in one task."""
    least = F.min(F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col("doc_id").alias("anchor"), F.col("component").alias("other")))
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), least.alias("a")).filter("lo < hi").select("key", "a.anchor", "a.other")
    mixed = rows.select("key", "doc_id", "component").join(several, "key")
    enough = mixed.groupBy("doc_id").agg(F.count("*").alias("has")).join(need, "doc_id").filter("has >= need").select("doc_id")
    return materialize(mixed.join(enough, "doc_id", "left_semi"), about)


def _commonest(votes: DataFrame, need: DataFrame) -> DataFrame:
    """(doc_id, anchor, n shared keys) -> (anchor, doc_id): each document's commonest anchor, if they share enough keys."""
    best = votes.groupBy("doc_id").agg(F.max_by("anchor", F.struct("n", -F.col("anchor"))).alias("anchor"), F.max("n").alias("n"))
    return best.join(need, "doc_id").filter("n >= need").select("anchor", "doc_id")


def _votes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "anchor").agg(F.count("*").alias("n"))


def _looked_up(rows: DataFrame, need: DataFrame, about: int) -> DataFrame:
    """(key, doc_id, component) -> (near, doc_id, component): the neighbourhoods where a document is searched, each named by the
    smallest component of a key that it looks up. Two documents that share `need` of their keys share one of the first (number -
    need + 1) in any order common to all: here the rarest first. A key is its count and half of its bits; those that only seem
    equal meet in vain."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    place = F.shiftleft(F.least("many", F.lit((1 << 31) - 1)), 32) + F.shiftrightunsigned("key", 32)
    ordered = rows.join(sizes, "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("keys"), F.count("*").alias("has"), F.min("component").alias("component")).join(need, "doc_id").filter("has >= need")
    keys = materialize(ordered.select("doc_id", "component", F.explode(F.slice("keys", 1, F.greatest(F.lit(0), F.col("has") - F.col("need") + 1))).alias("key")), about)
    least = keys.groupBy("key").agg(F.min("component").alias("near"), F.max("component").alias("hi")).filter("near < hi").select("key", "near")
    got = materialize(keys.join(least, "key").select("near", "doc_id", "component").distinct(), keys.count())
    discard(keys)
    return got


def _texts_of_sets(batches):
    """doc_id, text -> doc_id, text, n_shingles, two hashes of the set."""
    for batch in batches:
        for measured in _measure([batch]):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *measured.columns[1:4]], ["doc_id", "text", "n_shingles", "h1", "h2"])


def _parted(docs: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Where rows repeat a doc_id with different sets, each of these sets gets an id of its own, a hash that is no other id:
    (texts and measures under `doc_id`, the own id, measures with the true one in `owner`; links of the first of an owner's
    ids with its others). None where no id is repeated so."""
    several = measured.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n_shingles", "h1", "h2")).alias("lo"), F.max(F.struct("n_shingles", "h1", "h2")).alias("hi")).filter("lo <> hi").select("doc_id")
    several = materialize(several)
    n = several.count()
    if not n:
        return None
    few = F.broadcast(several) if n <= ASKED else several
    same_set, salt = ["doc_id", "n_shingles", "h1", "h2"], 0
    sets = materialize(measured.join(few, "doc_id", "left_semi").select(*same_set).distinct())
    ids = measured.select(F.col("doc_id").alias("own"))
    while True:
        own = sets.withColumn("own", F.xxhash64(*same_set, F.lit(salt)))
        if own.groupBy("own").count().filter("count > 1").isEmpty() and own.join(ids, "own", "left_semi").isEmpty():
            break
        salt += 1
    own = materialize(own)
    known = docs.filter("doc_id IS NOT NULL")
    split = materialize(known.join(few, "doc_id", "left_semi").mapInArrow(_texts_of_sets, "doc_id long, text string, n_shingles long, h1 long, h2 long").join(own, same_set).select(F.col("own").alias("doc_id"), "text"))
    texts = known.join(few, "doc_id", "left_anti").unionByName(split)
    measured = materialize(measured.join(own, same_set, "left").select(F.coalesce("own", "doc_id").alias("doc_id"), F.col("doc_id").alias("owner"), "n_shingles", "h1", "h2", "need", "sure"))
    first = own.groupBy("doc_id").agg(F.min("own").alias("a"))
    return texts, measured, own.join(first, "doc_id").filter("a <> own").select("a", F.col("own").alias("b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), class_id (the smallest doc_id
    with the same set) for every row of docs.

    Null, empty or wordless text: an empty set, linked with nothing. Rows that repeat a doc_id each keep their own set, and
    what one of them links to, all of that id do. Rows without doc_id get null ids and link with nothing. Other columns are
    ignored. Similar pairs are found exactly; only equality of shingles rests on hashes (64 bits)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id IS NOT NULL")
    measured = materialize(docs.mapInArrow(_measure, "doc_id long, n_shingles long, h1 long, h2 long, need int, sure boolean"))
    parted, total = _parted(docs, measured), measured.count()
    known, measured, siblings = parted or (known, measured.withColumn("owner", F.col("doc_id")), None)
    reps = measured.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("owner").alias("class"))
    # Rows of a hot class all meet one row of reps; Spark splits such a join.
    member = materialize(measured.join(reps, ["n_shingles", "h1", "h2"], "left").select("doc_id", "owner", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("class", "owner").alias("class")), total)
    need = measured.groupBy("doc_id").agg(F.min("need").alias("need"))
    same = materialize(member.filter("rep <> doc_id AND n_shingles > 0").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), total)
    same = materialize(same.unionByName(siblings).distinct(), 2 * total) if parted else same
    # The window's rows are a key's classes, once for each task that saw them.
    group = Window.partitionBy("key")
    met = known.mapInArrow(_keys, "doc_id long, key long").withColumn("anchor", F.min("doc_id").over(group)).withColumn("most", F.max("doc_id").over(group))
    shared = materialize(met.filter("anchor < most").select("key", "doc_id", "anchor"))
    votes = materialize(_votes(shared))
    asked = _commonest(votes.filter("doc_id <> anchor"), need).join(same.select(F.col("a").alias("anchor"), F.col("b").alias("doc_id")), ["anchor", "doc_id"], "left_anti")
    links = verified(asked, known, total)
    # Only a document that shares enough of its keys with others can link to any.
    able = materialize(votes.groupBy("doc_id").agg(F.sum("n").alias("has")).join(need, "doc_id").filter("has >= need").select("doc_id"), total)
    first = materialize(components(links.unionByName(same), 2 * total), total)
    named = first.withColumnRenamed("node", "doc_id")
    able = able.join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    n_able = able.count()
    able = F.broadcast(able) if n_able <= ASKED else able
    seed, rows = 1, _open(shared.select("key", "doc_id").join(able, "doc_id"), need, 1, KEYS * n_able)
    discard(shared, votes)
    while True:
        found = verified(_commonest(_votes(rows.filter("component <> other")), need), known, n_able)
        n, still, old = found.count(), rows.agg(F.count_distinct("doc_id")).first()[0], rows
        if n:
            links = links.unionByName(found)
            of = rows.select("doc_id", "component").distinct()
            ends = found.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            renamed = components(ends, 2 * n).toDF("component", "now")
            rows = rows.select("key", "doc_id", "component").join(renamed, "component", "left").select("key", "doc_id", F.coalesce("now", "component").alias("component"))
        seed += 1
        rows = _open(rows.select("key", "doc_id", "component"), need, seed, old.count())
        discard(old)
        if 20 * n <= still:
            break
    opened = rows
    rows = _looked_up(rows, need, rows.count())
    discard(opened)
    size = rows.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tasks = max(1, rows.count() // SEARCHED)
    blocked = rows.join(size, "near").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    meets = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("near", "doc_id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    left = materialize(rows.select("doc_id").distinct(), total)
    sketched = materialize(known.join(F.broadcast(left) if left.count() <= ASKED else left, "doc_id", "left_semi").mapInArrow(_sketches, "doc_id long, n long, sketch binary").dropDuplicates(["doc_id"]), total, SEARCHED)
    near = meets.join(sketched, "doc_id").groupBy(F.pmod(F.xxhash64("near", "i", "j"), F.lit(tasks)).alias("task")).applyInPandas(_search_blocks, "anchor long, doc_id long")
    more = verified(near, known)
    # Sets without the pigeonhole guarantee (next to none): all their shingles against everybody's.
    unsure = measured.filter(~F.col("sure") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if not unsure.isEmpty():
        weak = known.join(unsure, "doc_id", "left_semi").mapInArrow(_all_shingles, "doc_id long, keys array<long>").select(F.col("doc_id").alias("anchor"), F.explode("keys").alias("key"))
        every = known.mapInArrow(_all_shingles, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key"))
        more = more.unionByName(verified(every.join(weak, "key").filter("doc_id <> anchor").select("anchor", "doc_id"), known))
    labels = components(links.unionByName(more).unionByName(same), 3 * total + more.count())
    got = member.join(labels, member["doc_id"] == labels["node"], "left").select("doc_id", "owner", "n_shingles", F.coalesce("component", "doc_id").alias("component"), "class")
    if parted:  # a component is named by its least true id
        got = materialize(got, total)
        least = got.groupBy("component").agg(F.min("owner").alias("least"))
        got = got.join(least, "component", "left").withColumn("component", F.col("least"))
    return got.select(F.col("owner").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("class").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays, columns unchanged: the one with the least id, among several of that id the one whose text
    has the least hash. Rows that repeat an id with different texts are different documents; of equal rows one stays. Rows
    without id stay. No rows: none; null and wordless texts belong to no group, so they stay."""
    own = unused(docs, "own")
    ids = docs.filter("doc_id IS NOT NULL")
    repeated = materialize(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias(own)))
    if repeated.isEmpty():
        keep = jaccard_components(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).filter("doc_id = component_id").select("doc_id")
        return ids.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
    named = materialize(ids.join(repeated, "doc_id", "left").withColumn(own, F.when(F.col(own), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))))
    groups = jaccard_components(named.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias(own), F.col("component_id").alias("group"))
    first = groups.join(named.select(own, F.col("doc_id").alias("of")).distinct(), own).groupBy("group").agg(F.min(F.struct("of", own)).alias("least"))
    kept = named.join(first.select(F.col("least")[own].alias(own)), own, "left_semi").dropDuplicates([own])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
