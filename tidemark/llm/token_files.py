"""Token ids of a corpus in files of independently coded, checksummed blocks (range_coder), in ascending doc_id order.

A file is a Parquet dataset of chunks, written and committed by Spark's own writer, so a lost executor or a second attempt
leaves no half file behind. A chunk is a row:

    shard int, chunk int         place in the order; shards are ranges of doc_id
    doc_ids array<long>          its documents, whole, ascending
    n_tokens array<int>          ids of each, the end id included
    block_n array<int>           ids of each block; the blocks cut the chunk's ids into equal parts
    blocks array<binary>         coded blocks, each decodable by itself
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder as rc
from .shared import shared_dir, slices, text_buffers

#: Ids of a chunk, about: all lanes of the coder full. A document is never cut, so one of more ids makes a longer chunk.
CHUNK = rc.LANES * rc.BLOCK
#: Words whose ids a Python worker remembers at once (over its tasks).
REMEMBERED = 3 << 19
#: Bytes of text whose words are looked up at once.
LOOKED_UP = 4 << 20
END = 1
#: Signs after a word's letters that are parted from them (no apostrophe, which may begin a contraction, and no "<", which may begin a
#: special token), and letters beside ASCII's that normal form leaves as they are.
_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The pieces of a text for which that holds.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "shard int, chunk int, doc_ids array<long>, n_tokens array<int>, block_n array<int>, blocks array<binary>"
_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("block_n", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary()))])


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _letters_apart(tok) -> tuple:
    """Latin-1's letters as the pre-tokenizer names their bytes, and whether this tokenizer hands its model runs of letters in lower case."""
    from tokenizers.pre_tokenizers import ByteLevel

    steps = json.loads(tok.to_str())
    normal = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", ())]
    cut = (steps["pre_tokenizer"] or {}).get("pretokenizers", ())
    parts = len(cut) == 2 and cut[0].get("pattern") == {"Regex": _PIECES} and cut[0].get("invert") and (cut[1]["type"], cut[1].get("use_regex"), cut[1].get("add_prefix_space")) == ("ByteLevel", False, False)
    rename = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {k: rename(chr(k))[0][0] for k in range(0xC0, 0x100)}, bool(parts and normal == ["NFC", "Replace", "Lowercase"])


class WordTokenizer:
    """Ids of texts by way of their distinct words, for tokenizers none of whose tokens crosses ASCII white space.

    Of a word not seen before that is letters and perhaps signs after them, the letters (in lower case) and the signs are looked up
    apart, as the tokenizer parts them; letters not seen before go to the tokenizer's model as its normalizer and pre-tokenizers would
    hand them on. Other new words are encoded many at a time, parted by the special token `apart`; words that hold special tokens
    themselves are encoded alone. The result equals encoding whole texts (tests hold it against that)."""

    def __init__(self, path: str, apart: str = "<|endoftext|>"):
        self.tok, self.apart = tokenizer(path), apart
        self.apart_id = self.tok.token_to_id(apart)
        self.model = self.tok.model
        self.renamed, self.parted = _letters_apart(self.tok)
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, n: int) -> None:
        while n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after another, and each word's number of them."""
        size = self.size[code]
        at = np.repeat(self.start[code] - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return self.flat[at], size

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remembers words with their ids, one word's after another's."""
        k, m = len(self.known), len(words)
        self._room(k + m)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + m], self.size[k : k + m] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + m), strict=True))

    def _add(self, words: list[str]) -> None:
        """Encodes words that are not known, each once in the list."""
        pairs, others, letters, signs = [], {}, {}, {}
        for w in words:
            a = w.rstrip(_SIGNS) if self.parted else ""
            if a.isalpha() and (a.isascii() or _LATIN.fullmatch(a)):
                b, a = w[len(a) :], a.lower()
                if a not in self.known:
                    letters[a] = None
                if b and b not in self.known:
                    signs[b] = None
                if a != w:
                    pairs.append((w, a, b))
            else:
                others[w] = None
        self._add_letters([*letters])
        self._add_whole([*(signs | others)])
        if pairs:
            names, letters, after = zip(*pairs, strict=True)
            none = len(self.known)  # a place that holds no word yet
            code = np.empty((len(pairs), 2), np.int64)
            code[:, 0] = [*map(self.known.__getitem__, letters)]
            code[:, 1] = [self.known[a] if a else none for a in after]
            self._room(none + 1)
            self.start[none] = self.size[none] = 0
            ids, size = self._gather(code.reshape(-1))
            self._keep(names, ids, size.reshape(-1, 2).sum(1))

    def _add_letters(self, words: list[str]) -> None:
        ids, size, tokenize = [], [], self.model.tokenize
        for w in words:
            # Bytes of ASCII letters stand for themselves; others are renamed.
            got = tokenize(w if w.isascii() else w.translate(self.renamed))
            ids += [t.id for t in got]
            size.append(len(got))
        self._keep(words, np.array(ids, np.int64), np.array(size, np.int64))

    def _add_whole(self, words: list[str]) -> None:
        plain = [w for w in words if "<|" not in w]
        for w in words if len(plain) < len(words) else ():
            if "<|" in w:
                ids = np.array(self.tok.encode(w, add_special_tokens=False).ids, np.int64)
                self._keep([w], ids, np.array([len(ids)]))
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = np.array(self.tok.encode_batch_fast([f" {self.apart} ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            between = np.flatnonzero(ids == self.apart_id)
            self._keep(some, ids[ids != self.apart_id], np.diff(between, prepend=-1, append=len(ids)) - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) one after another, and the number of each text's."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        each = words.flatten().dictionary_encode()
        names = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(names) > REMEMBERED:
            self.forget()
        code = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(code < 0)
        if len(new):
            some = [names[i] for i in new.tolist()]
            self._add(some)
            code[new] = [*map(self.known.__getitem__, some)]
        ids, size = self._gather(code[each.indices.to_numpy()] if len(each) else np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids, np.diff(at)


@lru_cache(1)
def _words(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _chunk(shard: int, chunk: int, doc_ids: list, counts: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    blocks = np.array_split(every, max(1, -(-len(every) // rc.BLOCK)))
    row = {"shard": shard, "chunk": chunk, "doc_ids": doc_ids, "n_tokens": np.concatenate(counts).tolist() if counts else [], "block_n": [len(b) for b in blocks], "blocks": rc.encode(blocks)}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _writer(path: str, end: int):
    def write(batches):
        words, shard, chunk = _words(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, ids, total = [], [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, offsets = text_buffers(texts)
            for i, j in slices(offsets, LOOKED_UP):
                got, n = words.encode(texts.slice(i, j - i))
                out = np.insert(got, np.cumsum(n), end)
                doc_ids += batch.column(0).slice(i, j - i).to_pylist()
                counts.append(n + 1)
                ids.append(out)
                total += len(out)
                if total >= CHUNK:
                    yield _chunk(shard, chunk, doc_ids, counts, ids)
                    chunk, doc_ids, counts, ids, total = chunk + 1, [], [], [], 0
        if doc_ids:
            yield _chunk(shard, chunk, doc_ids, counts, ids)

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Writes the ids of every whole text (null: none) and the end id after each. Shards are ranges of doc_id, as many as
    spark.sql.shuffle.partitions; rows without doc_id come first; of equal doc_ids the lesser text comes first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(tokenizer_path, end), SCHEMA).write.option("compression", "none").parquet(path)


def _read(batches):
    out = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("coded_bytes", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            parts = rc.decode(row["blocks"], row["block_n"])
            ids = np.concatenate(parts).astype("<u4")
            ends = np.cumsum(row["n_tokens"])
            view, k = memoryview(ids).cast("B"), len(ends)
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), row["n_tokens"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * k, pa.int32()), pa.array([row["chunk"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["n_tokens"]), pa.array(row["n_tokens"], pa.int64()), pa.array(crc, pa.int64()), pa.array([sum(map(len, row["blocks"]))] * k, pa.int64())], schema=out)


def _ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.concatenate(rc.decode(row["blocks"], row["block_n"]))
            ends = np.concatenate([[0], np.cumsum(row["n_tokens"])])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, ids of every document, decoded from the files."""
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(_ids, "doc_id long, ids array<int>")


def describe(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded blocks of the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("shard", "chunk", F.aggregate("block_n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    # One row for each chunk of about 8 million ids.
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "chunk", before.alias("before"))
    got = files.mapInArrow(_read, "shard int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long, coded_bytes long")
    return got.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return describe(spark, path)
