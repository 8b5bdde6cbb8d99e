"""Matroska as a columnar source: EBML elements, clusters, lacing and cues become a packet table.

`packets` reads a media column into one row per frame: track, timestamp, byte range, keyframe, whether a cue points at its
cluster. `pcm_file` is the writer that the round trip needs: one track of 8-bit PCM.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
_TOP = frozenset({EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1941A469, 0x1254C367})
#: Samples of a frame, frames of a laced block, blocks of a cluster, and samples a second of the written files.
FRAME, LACE, BLOCKS, RATE = 1024, 8, 16, 8000


# --- reading -------------------------------------------------------------------------------------------------------------
def _id(data, at: int) -> tuple[int, int]:
    """Element id (marker bits kept) and where it ends."""
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _size(data, at: int) -> tuple[int | None, int]:
    """Variable-length size (None: unknown) and where it ends."""
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no element size at byte {at}")
    value = int.from_bytes(data[at : at + n], "big") - (1 << 7 * n)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data, at: int, end: int):
    """(id, start of the body, its end) of the elements between two bytes. An element of unknown size reaches to the next
    element of its level or above; a body that the file cuts short ends with the file."""
    while at < end:
        name, body = _id(data, at)
        size, body = _size(data, body)
        if size is None:
            stop = end if name == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = min(body + size, end)
        yield name, body, stop
        at = stop


def _unknown_end(data, at: int, end: int) -> int:
    while at < end:
        name, body = _id(data, at)
        if name in _TOP:
            return at
        size, body = _size(data, body)
        at = body if size is None else min(body + size, end)
    return end


def _uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lacing(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame after a block's header; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                before = at
                size, at = _size(data, at)
                if k:  # a signed difference, its zero in the middle of the range
                    size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


@dataclass
class Media:
    """Packets as columns, tracks as (number, type, codec), cues as (time, track, cluster byte)."""

    scale: int = 1_000_000
    track: list = field(default_factory=list)
    timestamp: list = field(default_factory=list)  # in scale units; frames of one block share it
    offset: list = field(default_factory=list)
    size: list = field(default_factory=list)
    key: list = field(default_factory=list)
    cluster: list = field(default_factory=list)  # byte of the packet's cluster element
    tracks: list = field(default_factory=list)
    cues: list = field(default_factory=list)


def parse(data: bytes) -> Media:
    """Reads a whole file; ValueError if it isn't well formed."""
    out, segment_body = Media(), 0

    def block(a: int, b: int, base: int, simple: bool, key: bool, at: int) -> None:
        number, body = _size(data, a)
        time = base + int.from_bytes(data[body : body + 2], "big", signed=True)
        flags = data[body + 2]
        for offset, size in lacing(data, body + 3, b, flags >> 1 & 3):
            out.track.append(number)
            out.timestamp.append(time)
            out.offset.append(offset)
            out.size.append(size)
            out.key.append(bool(flags & 0x80) if simple else key)
            out.cluster.append(at)

    at = 0
    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            at = b
            continue
        segment_body, at = a, a
        for child, c, d in elements(data, a, b):
            if child == INFO:
                for x, e, f in elements(data, c, d):
                    if x == TIMESTAMP_SCALE:
                        out.scale = _uint(data, e, f)
            elif child == TRACKS:
                for x, e, f in elements(data, c, d):
                    if x == TRACK_ENTRY:
                        own = {y: data[g:h] for y, g, h in elements(data, e, f)}
                        out.tracks.append((int.from_bytes(own.get(TRACK_NUMBER, b"\0"), "big"), int.from_bytes(own.get(TRACK_TYPE, b"\0"), "big"), own.get(CODEC_ID, b"").decode("ascii", "replace")))
            elif child == CUES:
                for x, e, f in elements(data, c, d):
                    point = list(elements(data, e, f)) if x == CUE_POINT else []
                    time = next((_uint(data, g, h) for y, g, h in point if y == CUE_TIME), 0)
                    for y, g, h in point:
                        if y == CUE_POSITIONS:
                            own = {z: _uint(data, i, j) for z, i, j in elements(data, g, h)}
                            out.cues.append((time, own.get(CUE_TRACK, 0), segment_body + own.get(CUE_CLUSTER, 0)))
            elif child == CLUSTER:
                base = 0
                for x, e, f in elements(data, c, d):
                    if x == TIMESTAMP:
                        base = _uint(data, e, f)
                    elif x == SIMPLE_BLOCK:
                        block(e, f, base, True, False, at)
                    elif x == BLOCK_GROUP:
                        inner = list(elements(data, e, f))
                        key = all(y != REFERENCE for y, _, _ in inner)
                        for y, g, h in inner:
                            if y == BLOCK:
                                block(g, h, base, False, key, at)
            at = d
    return out


# --- writing -------------------------------------------------------------------------------------------------------------
def _vint(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def simple_block(track: int, delta: int, frames: list[bytes], kind: int) -> bytes:
    """A SimpleBlock of key frames under the given lacing."""
    head = _vint(track) + delta.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
    if kind:
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            diff = b - a
            length = next(k for k in range(1, 9) if abs(diff) < (1 << 7 * k - 1) - 1)
            head += (diff + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def pcm_file(samples: bytes) -> bytes:
    """A file of one mono track of unsigned 8-bit PCM samples; equal samples give equal files. Full blocks have fixed lacing, the
    last one of several frames EBML lacing, a single frame none. Every cluster has a cue."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ_VERSION, 2))
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING, np.array(RATE, ">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_block = FRAME * LACE
    for c in range(0, len(samples), per_block * BLOCKS):
        time, body = c * 1000 // RATE, []
        for b in range(c, min(c + per_block * BLOCKS, len(samples)), per_block):
            frames = [samples[f : f + FRAME] for f in range(b, min(b + per_block, len(samples)), FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            body.append(simple_block(1, b * 1000 // RATE - time, frames, kind))
        cluster = element(CLUSTER, _number(TIMESTAMP, time) + b"".join(body))
        cues.append(element(CUE_POINT, _number(CUE_TIME, time) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# --- Spark ---------------------------------------------------------------------------------------------------------------
PACKETS = "media_id long, packet long, track int, timestamp_ns long, offset long, size long, keyframe boolean, cued boolean, error string"


def packets(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """One row per frame of every file, in file order. A null or empty file has no packet; a malformed one a single row whose
    error says why. Other columns are ignored."""

    def run(batches):
        names = [x.strip().split()[0] for x in PACKETS.split(",")]
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    m = parse(data or b"")
                    cued = {c[2] for c in m.cues}
                    n = len(m.size)
                    cols = [pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(m.track, pa.int32()), pa.array([t * m.scale for t in m.timestamp], pa.int64()), pa.array(m.offset, pa.int64()), pa.array(m.size, pa.int64()), pa.array(m.key, pa.bool_()), pa.array([c in cued for c in m.cluster], pa.bool_()), pa.nulls(n, pa.string())]
                except (ValueError, IndexError) as e:
                    cols = [pa.array([key], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())), pa.array([str(e)], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("data")).mapInArrow(run, PACKETS)


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text (null: none) and them with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def feature(samples: bytes) -> str:
    """Sum, energy about the middle, crossings of the middle, and the commonest sample."""
    x = np.frombuffer(samples, np.uint8)
    y = x.astype(np.int32) - 128
    hist = np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    return f"sum={int(hist @ values)};energy={int(hist @ (values * values))};crossings={int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))};mode={int(hist.argmax())}"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, data: every whole text stored as a PCM file. A null or empty text has 64 bytes of silence (n_bytes 0); repeated
    rows are repeated, equal texts have equal files, a null id stays null. No rows, no files; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = [payload(t) for t in batch.column(1).slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array([n for n, _ in some], pa.int64()), pa.array([pcm_file(x) for _, x in some], pa.large_binary())], ["doc_id", "n_bytes", "data"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, data binary")


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, data -> what is read back through the packets' byte ranges, and its feature; a row for each row. Null data and
    files that are malformed have null in all that is read back (of the latter the stored form's size and hash are known)."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
        for batch in batches:
            rows = []
            for data in batch.column(2):
                data = data.as_py()
                if data is None:
                    rows.append((None,) * 7)
                    continue
                try:
                    m = parse(data)
                except (ValueError, IndexError):
                    rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None))
                    continue
                got = b"".join([data[o : o + n] for o, n in zip(m.offset, m.size, strict=True)])
                rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(got), len(m.size)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")


def op4(spark, sf_dir: str) -> DataFrame:
    return describe(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
