"""Helpers the training-data operators share: materialised cuts, folds, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = 0xFFFFFFFFFFFFFFFF
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes of text hashed at a time; bounds the temporary arrays (about 40 bytes per byte of text).
SLICE_BYTES = 1 << 20
#: Texts sent to Python in one batch; rows of ids in a file, where their number is known.
BATCH_ROWS, FILE_ROWS = 500, 8192
#: Intermediate tables need no marker of success: they are read only where the writing returned.
PLAIN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: The folder of each materialised frame.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only where that is unset and all runs in one process (local mode, as in tests) a local
    folder is set; a cluster without the setting is refused, since each executor has its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Cuts the lineage: writes to the shared folder and reads again, so lost executors cost no recomputation. rows: about how many
    there are at most, where that is known; one task writes `each` of them (there are no more tasks than the frame has)."""
    path = shared_dir(df.sparkSession)
    small = df if rows is None else df.coalesce(rows // each + 1)
    small.write.options(**PLAIN).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[got] = path
    return got


def discard(*frames: DataFrame) -> None:
    """Empties the folders that materialize wrote for these very frames. Only for frames that nothing reads any more: not for those that a
    lazy result rests on."""
    for df in frames:
        path = _FOLDERS.pop(df, None)
        if path:
            df.sparkSession.createDataFrame([], "gone int").coalesce(1).write.options(**PLAIN).mode("overwrite").parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows that travel to Python at a time: BATCH_ROWS at most from now on in this session (a lower setting stays). The
    default of 10,000 would hold a whole task's texts several times over, in the JVM's buffers and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k: the folds that learned operators keep apart."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


def as_int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash's base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", _P), ("down", _PINV)):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.cumprod(x, dtype=np.uint64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Hash value of each byte, A-Z as a-z; and with A-Z apart.
BYTE_HASH, CASED_HASH = _BYTE[_LOWER], _BYTE
#: The white space that separates words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the len + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of about `most` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets of the maximal runs of bytes that `inside` (256 booleans) marks; none crosses a row."""
    member = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = ~member[:-1] | cut[1:-1]
        after[:-1] = ~member[1:] | cut[1:-1]
    starts = np.flatnonzero(member & before)
    ends = np.flatnonzero(member & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes of any byte ranges of one buffer by a prefix sum; `table` has a value for each byte."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_HASH):
        _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _Powers.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, parted by ASCII white space) and each row's offsets among them."""
    starts, ends, rows = runs(data, offsets, ~SPACE)
    return Hasher(data).of(starts, ends), rows


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place (len - n + 1 values)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    return total


def shingle_sets(col: pa.Array, k: int = 5):
    """Per row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence; without words empty."""
    data, offsets = text_buffers(col)
    for i, j in slices(offsets):
        words, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grams = ngram_hashes(words, k)
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix(ngram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
