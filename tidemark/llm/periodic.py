"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words of smallest period q that is at least 3 q (and 24 words) long and that no neighbour extends.

1. The words are factored into Lempel-Ziv blocks. A square whose leftmost occurrence is there ends beyond the block in which it
   is centred, so common extensions to both sides of the block borders give, for every distinct square, a pair (start, period) from
   which its leftmost occurrence is reached by shifts: the leftmost-covering set, of linear size.
2. The pairs are located in the suffix tree: from the leaf of each start upwards as long as that leaf is a node's first.
3. From each location a suffix link, a step down by skip and count, and one more word lead to the square's next rotation. Walks
   end at a location that is known or where no rotation occurs: the vocabulary of all distinct squares is complete.
4. The leaves below a square's location are its occurrences. Those with a primitive root are merged: neighbouring starts of one
   period are one run.

Texts do not meet, so nothing is shuffled: each task reads its documents once. The suffix structures are built only over regions
that can hold a run (no run is lost): every eight words that begin inside a run occur again at a distance of at most a third of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CASED_HASH, SPACE, Hasher, mix, ngram_hashes, runs, slices, text_buffers

#: Words of a run at least, and copies of its period.
LEAST, COPIES = 24, 3
#: Words that a place of a region shares with another.
SEED = 8
RUNS = "array<struct<start: long, length: long, period: long>>"


class Factors:
    """Names of all stretches whose length is a power of two: equal names, equal words. Stretches are cut at the end of their
    region, and a cut one equals no other. Common extensions are found by halving."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """words: numbers; begins, ends: the region of each place."""
        n = len(words)
        self.begins = begins
        _, rank = np.unique(words, return_inverse=True)
        _, rank = np.unique(begins * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)
        self.levels, width = [np.append(rank, -1).astype(np.int32)], 1
        while n and int(rank.max()) + 1 < n:
            later = np.arange(width, n + width)
            inside = later < ends
            _, rank = np.unique(rank * (n + 1) + np.where(inside, rank[np.where(inside, later, 0)] + 1, 0), return_inverse=True)
            self.levels.append(np.append(rank, -1).astype(np.int32))
            width *= 2
        #: The suffixes of each region in order, region by region.
        self.order = np.argsort(rank)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i and from j on, i < j, j at most the end of i's region."""
        i, j = i.copy(), j.copy()
        before = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - before

    def backward(self, i: np.ndarray, j: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Common words that end at i and at j, i < j."""
        i, j = i.copy(), j.copy()
        before = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a = i - (1 << k) + 1
            inside = a >= begins
            step = (inside & (self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, j - (1 << k) + 1, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return before - i


def blocks(order: list[int], common: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks (and the end): each is the longest stretch that also begins earlier, or a new word.
    common: the words that neighbours in order share."""
    n = len(order)
    longest, open_ = [0] * n, []
    for place, shared in zip([*order, -1], [*common, 0], strict=True):
        while open_ and place < open_[-1][0]:
            at, before = open_.pop()
            longest[at] = max(before, shared)
            shared = min(before, shared)
        open_.append((place, shared))
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += max(1, longest[at])
    return [*starts, n]


def covering(factors: Factors, first: np.ndarray, last: np.ndarray, after: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks [first, last) whose next one ends at `after`, in regions [begins, ends) -> starts and periods of squares that cover
    the leftmost ones."""
    most = (ends - begins) // 2

    def each(counts):
        own = np.repeat(np.arange(len(counts)), counts)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    out = []
    # Centred in a block, ending in the next.
    own, k = each(np.where(last < ends, np.minimum(last - first, most), 0))
    right = last[own]
    left = right - k
    ahead, back = factors.forward(left, right), factors.backward(left - 1, right - 1, begins[own])
    start = np.maximum(left - back, left - k + 1)
    ok = (ahead + back >= k) & (ahead > 0)
    out.append((start[ok], k[ok]))
    # Begun before a block, centred in it, reaching the next at most.
    own, k = each(np.where(first > begins, np.minimum(after - first, most), 0))
    left = first[own]
    right = left + k
    fits = right < ends[own]
    own, k, left, right = own[fits], k[fits], left[fits], right[fits]
    ahead, back = factors.forward(left, right), factors.backward(left - 1, right - 1, begins[own])
    start = np.maximum(left - back, left - k + 1)
    ok = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= last[own])
    out.append((start[ok], k[ok]))
    return np.concatenate([s for s, _ in out]), np.concatenate([p for _, p in out])


class Tree:
    """The suffix tree of one region. Nodes are numbers: 0 the root, inner nodes, then the leaves in order of their suffixes.
    depth: words from the root; low: the first of a node's leaves; high: the last; up: the node above; first: the leftmost start."""

    def __init__(self, words: list[int], order: list[int], common: list[int]):
        n = len(order)
        self.words, self.order = words, order
        depth, low, high, up, first, above, path = [0], [0], [n - 1], [-1], [0], [0] * n, [0]
        for r in range(1, n + 1):
            shared = common[r] if r < n else 0
            above[r - 1] = path[-1]
            left, below = r - 1, -1
            if order[r - 1] < first[path[-1]]:
                first[path[-1]] = order[r - 1]
            while depth[path[-1]] > shared:
                below = path.pop()
                high[below], left = r - 1, low[below]
                if depth[path[-1]] >= shared:
                    up[below] = path[-1]
                    first[path[-1]] = min(first[path[-1]], first[below])
            if depth[path[-1]] < shared:
                node = len(depth)
                depth.append(shared)
                low.append(left)
                high.append(n - 1)
                up.append(-1)
                if below >= 0:
                    up[below] = node
                    first.append(first[below])
                else:
                    above[r - 1] = node
                    first.append(order[r - 1])
                path.append(node)
        self.inner = len(depth)
        self.depth, self.low, self.high = depth + [n - s for s in order], low + list(range(n)), high + list(range(n))
        self.up, self.first = up + above, first + order
        self.links: dict[int, int] = {0: 0}
        self.wide = max(words, default=0) + 1
        self.below = {}
        for v in range(1, len(self.depth)):
            u = self.up[v]
            at = order[self.low[v]] + self.depth[u]
            if at < n:
                self.below[u * self.wide + words[at]] = v

    def descend(self, node: int, start: int, length: int) -> int:
        """From a node that spells words from `start` on, down until `length` of them are spelled."""
        while self.depth[node] < length:
            node = self.below[node * self.wide + self.words[start + self.depth[node]]]
        return node

    def link(self, node: int) -> int:
        """The suffix link of an inner node: the node that spells the same without the first word."""
        todo = []
        while node not in self.links:
            todo.append(node)
            node = self.up[node]
        for v in reversed(todo):
            u = self.up[v]
            self.links[v] = self.descend(self.links[u], self.order[self.low[v]] + 1, self.depth[v] - 1)
            node = v
        return self.links[node]

    def located(self, squares: dict[int, list[int]]) -> list[tuple[int, int]]:
        """Lengths of squares by start -> (node below the square's end, length) of those whose start is their leftmost."""
        at = {s: self.inner + r for r, s in enumerate(self.order) if s in squares}
        out = []
        for start, lengths in squares.items():
            node, lengths = at[start], sorted(lengths)
            while lengths and node and self.first[node] == start:
                over = self.depth[self.up[node]]
                while lengths and lengths[-1] > over:
                    out.append((node, lengths.pop()))
                node = self.up[node]
        return out

    def vocabulary(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """All distinct squares, as located, from those of a leftmost-covering set: walks over rotations."""
        depth, words, order, low, n = self.depth, self.words, self.order, self.low, len(self.order)
        known = set(found)
        for place in found:
            node, length = place
            while True:
                start = order[low[node]]
                node = self.descend(self.link(self.up[node]), start + 1, length - 1)
                if depth[node] == length - 1:
                    node = self.below.get(node * self.wide + words[start], -1)
                    if node < 0:
                        break
                else:
                    end = order[low[node]] + length - 1
                    if end >= n or words[end] != words[start]:
                        break
                if (node, length) in known:
                    break
                known.add((node, length))
        return list(known)


def _regions(words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of the stretches of words (rows: offsets of the texts) that can hold a run."""
    n = len(words)
    if n < LEAST:
        return []
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    grams = ngram_hashes(words, SEED)
    inside = text[: len(grams)] == text[SEED - 1 :]
    place = np.flatnonzero(inside)
    key = mix(grams[place] + text[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = place[order][1:] - place[order][:-1]
    gap[~same] = n
    far = np.full(len(place), n)
    far[order[1:]] = gap
    far[order[:-1]] = np.minimum(far[order[:-1]], gap)
    distance = np.full(n, n)
    distance[place] = far
    near = distance < n
    while True:
        step = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # Places of one text follow each other only inside it: the last SEED - 1 words of a text begin none.
        length = b - a + SEED - 1
        keep = length >= LEAST
        a, b, length = a[keep], b[keep], length[keep]
        within = np.zeros(n + 1, np.int64)
        np.add.at(within, a, length // COPIES)
        np.add.at(within, b, -(length // COPIES))
        now = near & (distance <= np.cumsum(within)[:-1])
        if (now == near).all():
            return list(zip(a.tolist(), (b + SEED - 1).tolist(), strict=True))
        near = now


def _primitive(factors: Factors, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares' halves are no powers."""
    least = np.arange(int(period.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            least[p * p :: p] = np.where(least[p * p :: p] == np.arange(p * p, len(least), p), p, least[p * p :: p])
    rest, ok = period.copy(), np.ones(len(period), bool)
    while True:
        todo = np.flatnonzero((rest > 1) & ok)
        if not len(todo):
            return ok
        prime = least[rest[todo]]
        part = period[todo] // prime
        ok[todo] = factors.forward(start[todo], start[todo] + part) < period[todo] - part
        rest[todo] //= prime


def find_runs(words: np.ndarray, rows: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in texts of words (hashes; rows: the offsets of the texts), by start, then period."""
    regions = _regions(words, rows)
    if not regions:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.array([b - a for a, b in regions])
    shift = np.concatenate([[0], np.cumsum(sizes)])
    back = np.array([a for a, _ in regions]) - shift[:-1]
    taken = np.concatenate([np.arange(a, b) for a, b in regions])
    region = np.repeat(np.arange(len(regions)), sizes)
    begins, ends = shift[:-1][region], shift[1:][region]
    factors = Factors(words[taken], begins, ends)
    order = factors.order
    common = np.zeros(len(order), np.int64)
    follows = np.flatnonzero(region[1:] == region[:-1]) + 1
    a, b = order[follows - 1], order[follows]
    common[follows] = factors.forward(np.minimum(a, b), np.maximum(a, b))
    _, numbers = np.unique(words[taken], return_inverse=True)
    local = [((order[x:y] - x).tolist(), common[x:y].tolist()) for x, y in zip(shift[:-1], shift[1:], strict=True)]
    cut = [np.array(blocks(*o)) + x for o, x in zip(local, shift[:-1], strict=True)]
    first, last, own = np.concatenate([c[:-1] for c in cut]), np.concatenate([c[1:] for c in cut]), np.repeat(np.arange(len(cut)), [len(c) - 1 for c in cut])
    after = np.concatenate([np.append(c[2:], c[-1]) for c in cut])
    start, period = covering(factors, first, last, after, shift[:-1][own], shift[1:][own])
    of = region[start]
    by = np.argsort(of, kind="stable")
    start, period, edges = start[by], period[by], np.searchsorted(of[by], np.arange(len(regions) + 1))
    low, high, twice, base = [], [], [], []
    for r, (x, y) in enumerate(zip(shift[:-1].tolist(), shift[1:].tolist(), strict=True)):
        if edges[r] < edges[r + 1]:
            squares: dict[int, list[int]] = {}
            for s, p in sorted(set(zip((start[edges[r] : edges[r + 1]] - x).tolist(), period[edges[r] : edges[r + 1]].tolist(), strict=True))):
                squares.setdefault(s, []).append(2 * p)
            _, dense = np.unique(numbers[x:y], return_inverse=True)
            tree = Tree(dense.tolist(), *local[r])
            every = tree.vocabulary(tree.located(squares))
            low += [tree.low[v] + x for v, _ in every]
            high += [tree.high[v] + x for v, _ in every]
            twice += [length for _, length in every]
            base += [r] * len(every)
    low, high, base, half = np.array(low, np.int64), np.array(high, np.int64), np.array(base, np.int64), np.array(twice, np.int64) // 2
    ok = _primitive(factors, order[low], half)
    low, high, base, half = low[ok], high[ok], base[ok], half[ok]
    counts = high - low + 1
    at = order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    period, base = np.repeat(half, counts), np.repeat(base, counts)
    by = np.lexsort((at, period, base))
    at, period, base = at[by], period[by], base[by]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(period) != 0) | (np.diff(base) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    length, period, start = at[tail] - at[head] + 2 * period[head], period[head], at[head] + back[base[head]]
    keep = length >= np.maximum(least, copies * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _read(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets):
            own, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, rows = runs(own, cuts, ~SPACE)
            start, length, period = find_runs(Hasher(own, CASED_HASH).of(starts, ends), rows)
            text = np.searchsorted(rows, start, "right") - 1
            edges = np.searchsorted(text, np.arange(j - i + 1))
            raw, found, kept = own.tobytes(), [], []
            for t in range(j - i):
                words = raw[cuts[t] : cuts[t + 1]].split()
                mine = [(int(s - rows[t]), int(n), int(p)) for s, n, p in zip(start[edges[t] : edges[t + 1]], length[edges[t] : edges[t + 1]], period[edges[t] : edges[t + 1]], strict=True)]
                if mine:
                    dropped = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in mine:
                        dropped[s + p] += 1
                        dropped[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)]
                found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(rows), pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed (the words that no run contains
    after its first period, parted by single spaces) for every row of docs.

    Null, empty or wordless text: no words, no runs, an empty text. Texts of under 24 words have no run. Rows are read one by one:
    repeated ids and equal rows give a row each, a null id stays null. No rows, no result. Other columns are ignored. Equality
    of words rests on 64-bit hashes; memory follows the longest text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_read, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text where a tenth of the documents, by a hash of the id, repeat from some word on: word i >= a becomes word
    a + (i - a) % p. Rows without id or words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    d = d.withColumn("a", F.when(n > 0, F.pmod("g", n))).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.col("words")[place(i)]), " ")
    return d.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    first = lambda x, y: F.when(more(x, y) > 0, -1).when(more(x, y) < 0, 1).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    best = F.get(F.array_sort("runs", first), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (
        found.withColumn("best", best)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    )
