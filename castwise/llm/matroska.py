"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.llm.common import query, read, utf8

# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B)
TIMESTAMP_SCALE, DURATION, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC, DEFAULT_DURATION = (
    0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383)
SAMPLING_RATE, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = (
    0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285)
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3

RATE = 8_000  # samples a second: eight samples a tick of one millisecond
FRAME = 64  # samples of a frame: eight ticks
FRAMES_PER_BLOCK = 128
BLOCKS_PER_CLUSTER = 16


class MediaError(ValueError):
    """The bytes are not a well-formed file of this format."""


# ---- writing

def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the shortest that does not look like "unknown" unless ``width`` is given."""
    if not width:
        width = 1
        while value >= (1 << (7 * width)) - 1:
            width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(id_: int, value: int) -> bytes:
    return element(id_, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    """Frame count and sizes in front of the frames of one block."""
    if kind == NO_LACE:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == XIPH_LACE:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACE:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for before, size in zip(sizes[:-1], sizes[1:-1]):
            width = 1
            while not -(1 << (7 * width - 1)) < size - before < 1 << (7 * width - 1):
                width += 1
            head += vint(size - before + (1 << (7 * width - 1)) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing takes frames of one size")
    return head + b"".join(frames)


def block(track: int, ticks: int, frames: list[bytes], kind: int) -> bytes:
    return vint(track) + struct.pack(">hB", ticks, 0x80 | kind << 1) + _lace(frames, kind)


def mux(payload: bytes, lacing: int = FIXED_LACE, frame: int = FRAME) -> bytes:
    """``payload`` as 8-bit mono samples of one audio track, laced into simple blocks, with cues.

    Nothing in the file depends on anything but the payload.
    """
    tick = frame * 1000 // RATE
    header = element(EBML, b"".join([
        unsigned(VERSION, 1), unsigned(READ_VERSION, 1), unsigned(ID_LENGTH, 4), unsigned(SIZE_LENGTH, 8),
        element(DOC_TYPE, b"matroska"), unsigned(DOC_VERSION, 4), unsigned(DOC_READ_VERSION, 2)]))
    frames = -(-len(payload) // frame)
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * tick)))
    audio = element(SAMPLING_RATE, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    track = element(TRACK, b"".join([
        unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), unsigned(FLAG_LACING, 1),
        element(CODEC, b"A_PCM/INT/LIT"), unsigned(DEFAULT_DURATION, tick * 1_000_000), element(AUDIO, audio)]))
    body = [info, element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    per_block = 1 if lacing == NO_LACE else FRAMES_PER_BLOCK
    for first in range(0, frames, per_block * BLOCKS_PER_CLUSTER):
        parts = [unsigned(CLUSTER_TIME, first * tick)]
        for start in range(first, min(frames, first + per_block * BLOCKS_PER_CLUSTER), per_block):
            stop = min(frames, start + per_block)
            cut = [payload[i * frame: (i + 1) * frame] for i in range(start, stop)]
            parts.append(element(SIMPLE_BLOCK, block(1, (start - first) * tick, cut, lacing)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, first * tick) + element(
            CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


# ---- reading

@dataclass
class Packets:
    """What a file holds; ``packets`` rows are (track, timestamp in ns, byte offset, byte length, keyframe, cluster offset)."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (timestamp in ns, track, cluster offset)
    clusters: int = 0


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, the place behind it, and whether all its value bits are set ("unknown")."""
    if at >= len(data) or data[at] == 0:
        raise MediaError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError("a number is cut off")
    raw = int.from_bytes(data[at: at + width], "big")
    value = raw if keep_marker else raw & (1 << (7 * width)) - 1
    return value, at + width, raw & (1 << (7 * width)) - 1 == (1 << (7 * width)) - 1


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """``(id, start, body start, body end)`` of the elements between two bytes.

    An element of unknown size ends where an element begins that cannot be inside it.
    """
    while at < end:
        id_, size_at, _ = _vint(data, at, keep_marker=True)
        size, body, unknown = _vint(data, size_at)
        stop = body + size
        if unknown:
            if id_ not in (SEGMENT, CLUSTER):
                raise MediaError("only segments and clusters may have no size")
            stop = body
            while stop < end:
                inner, inner_size, _ = _vint(data, stop, keep_marker=True)
                if inner in (SEGMENT, EBML) or id_ == CLUSTER and inner in TOP_LEVEL:
                    break
                length, inner_body, open_end = _vint(data, inner_size)
                stop = end if open_end else inner_body + length
            stop = min(stop, end) if id_ == CLUSTER else end
        if stop > end:
            raise MediaError("an element is longer than what holds it")
        yield id_, at, body, stop
        at = stop


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of one block body."""
    if kind == NO_LACE:
        return [(at, end)]
    if at >= end:
        raise MediaError("a laced block is empty")
    count, at = data[at] + 1, at + 1
    if kind == FIXED_LACE:
        size, odd = divmod(end - at, count)
        if odd:
            raise MediaError("frames of a fixed lace differ")
        return [(at + i * size, at + (i + 1) * size) for i in range(count)]
    sizes = []
    if kind == XIPH_LACE:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise MediaError("lace sizes are cut off")
                byte, at = data[at], at + 1
                size += byte
                if byte != 255:
                    break
            sizes.append(size)
    elif count > 1:
        size, at, _ = _vint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            begun = at
            raw, at, _ = _vint(data, at)
            size += raw - ((1 << (7 * (at - begun) - 1)) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("lace sizes exceed their block")
    starts = [at, *(at + s for s in np.cumsum(sizes[:-1]).tolist())]
    return [(s, s + n) for s, n in zip(starts, sizes)]


def parse(data: bytes) -> Packets:
    """Packet table of a file; raises ``MediaError`` for bytes that are not one."""
    out, pending = Packets(), []

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def children(a: int, b: int) -> dict[int, tuple[int, int]]:
        return {id_: (x, y) for id_, _, x, y in elements(data, a, b)}

    def read_block(a: int, b: int, cluster: int, time: int, key: bool | None) -> None:
        track, a, _ = _vint(data, a)
        if a + 3 > b:
            raise MediaError("a block is cut off")
        ticks, flags = struct.unpack(">hB", data[a: a + 3])
        pending.append((track, time + ticks, _frames(data, a + 3, b, flags >> 1 & 3),
                        bool(flags & 0x80) if key is None else key, cluster))

    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MediaError("no header")
    head = children(*top[0][2:])
    out.doc_type = data[slice(*head[DOC_TYPE])].decode() if DOC_TYPE in head else "matroska"
    segment = next((e for e in top if e[0] == SEGMENT), None)
    if segment is None:
        raise MediaError("no segment")
    base = segment[2]
    for id_, at, a, b in elements(data, base, segment[3]):
        if id_ == INFO:
            found = children(a, b)
            out.scale = number(*found[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in found else out.scale
        elif id_ == TRACKS:
            for _, _, x, y in (e for e in elements(data, a, b) if e[0] == TRACK):
                found = children(x, y)
                audio = children(*found[AUDIO]) if AUDIO in found else {}
                out.tracks[number(*found[TRACK_NUMBER])] = {
                    "type": number(*found[TRACK_TYPE]), "codec": data[slice(*found[CODEC])].decode(),
                    "frame_ns": number(*found[DEFAULT_DURATION]) if DEFAULT_DURATION in found else 0,
                    "channels": number(*audio[CHANNELS]) if CHANNELS in audio else 1,
                    "bits": number(*audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0}
        elif id_ == CLUSTER:
            out.clusters += 1
            time = 0
            for kind, _, x, y in elements(data, a, b):
                if kind == CLUSTER_TIME:
                    time = number(x, y)
                elif kind == SIMPLE_BLOCK:
                    read_block(x, y, at - base, time, None)
                elif kind == BLOCK_GROUP:
                    found = children(x, y)
                    if BLOCK in found:
                        read_block(*found[BLOCK], at - base, time, 0xFB not in found)
        elif id_ == CUES:
            for _, _, x, y in (e for e in elements(data, a, b) if e[0] == CUE_POINT):
                time = number(*children(x, y)[CUE_TIME])
                for _, _, p, q in (e for e in elements(data, x, y) if e[0] == CUE_POSITIONS):
                    found = children(p, q)
                    out.cues.append((time, number(*found[CUE_TRACK]), number(*found[CUE_CLUSTER])))
    for track, ticks, ranges, key, cluster in pending:
        step = out.tracks.get(track, {}).get("frame_ns", 0)
        out.packets += [(track, ticks * out.scale + i * step, a, b - a, key, cluster) for i, (a, b) in enumerate(ranges)]
    out.cues = [(t * out.scale, track, at) for t, track, at in out.cues]
    return out


def payload_of(data: bytes, found: Packets, track: int = 1) -> bytes:
    """The track's frames in time order, joined."""
    rows = sorted((t, at, n) for tr, t, at, n, _, _ in found.packets if tr == track)
    return b"".join([data[at: at + n] for _, at, n in rows])


PACKET_FIELDS = "packet bigint, track bigint, timestamp_ns bigint, byte_offset bigint, byte_length bigint, keyframe boolean, cluster_offset bigint, cued boolean"


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row per packet of every file in ``column``: its track, time, byte range, cluster, and whether a cue names its cluster.

    Null, empty and malformed files have no packets. Other columns are ignored, repeated rows repeat.
    """
    bare = media.select(F.col(key).alias("key"), F.col(column).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("media").to_pylist()):
                try:
                    found = parse(data or b"")
                except MediaError:
                    continue
                cued = {(track, at) for _, track, at in found.cues}
                rows = [(n, *p, (p[0], p[5]) in cued) for n, p in enumerate(found.packets)]
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at: at + 10_000]))
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]
                    columns = [pa.array(v, k) for v, k in zip(part, kinds)]
                    keys = batch.column("key").take(pa.array([i] * len(part[0]), pa.int64()))
                    names = ["key", *(f.split()[0] for f in PACKET_FIELDS.split(", "))]
                    yield pa.RecordBatch.from_arrays([keys, *columns], names)

    kind = media.schema[key].dataType.simpleString()
    return bare.mapInArrow(run, f"key {kind}, {PACKET_FIELDS}").withColumnRenamed("key", key)


@F.pandas_udf(T.BinaryType())
def media_of(text: pd.Series) -> pd.Series:
    """File that stores a text's bytes, filled up with zero bytes to a positive multiple of ``FRAME``."""
    return text.map(lambda b: mux(b + b"\0" * (-len(b) % FRAME or (0 if b else FRAME))))


PROBED = (T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long")
          .add("media_bytes", "long").add("media_sha256", "string").add("feature", "string"))


@F.pandas_udf(PROBED)
def probe(media: pd.Series) -> pd.DataFrame:
    """What is read back from a file: digests of payload and file, and features of its packets and samples."""
    rows = []
    for data in media:
        found = parse(data)
        payload = payload_of(data, found)
        samples = np.frombuffer(payload, np.uint8)
        centred = samples.astype(np.float32) - 128
        duration = max((t for _, t, *_ in found.packets), default=0) // 1_000_000 + FRAME * 1000 // RATE
        crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
        feature = (
            f"tracks={len(found.tracks)} clusters={found.clusters} packets={len(found.packets)} cues={len(found.cues)} "
            f"duration_ms={duration} mean={samples.mean(dtype=np.float64):.4f} "
            f"rms={np.sqrt(np.square(centred).mean(dtype=np.float64)):.4f} crossings={crossings} peak={int(samples.max())}")
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]),
                     len(data), hashlib.sha256(data).hexdigest(), feature))
    return pd.DataFrame(rows, columns=PROBED.names)


@query("op8_matroska")
def op8_matroska(spark: SparkSession, folder: str) -> DataFrame:
    """Every document stored as the samples of an audio file, parsed back and probed."""
    docs = read(spark, folder, "documents").select("doc_id", utf8(F.col("text")).alias("data"))
    stored = docs.select("doc_id", F.length("data").cast("bigint").alias("n_bytes"), media_of("data").alias("media"))
    return stored.select("doc_id", "n_bytes", probe("media").alias("p")).select("doc_id", "n_bytes", "p.*")
