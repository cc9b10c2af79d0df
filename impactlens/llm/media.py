"""Matroska: texts stored as 8-bit PCM audio in .mkv form, and parsed back into packet tables.

`muxed` writes an EBML header, segment information, one audio track, clusters of laced blocks and cues. `packets`
parses any such file: variable-length element ids and sizes (also unknown sizes), clusters, all three lacings, block
groups, and cues, into a table of packets with track, timestamp and byte range.

Semantics
- A null text is an empty one. The payload is the text's UTF-8 bytes, filled up with byte 255 to a positive multiple of
  `FRAME`. Equal texts give equal files and features; repeated rows are kept; an empty table gives an empty result.
- Extra columns are ignored. Each text is worked on as a whole and alone, so memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from impactlens.llm.common import slices, stored

FRAME = 576
RATE = 8000
#: Frames in a block, blocks in a cluster.
LACE, BLOCKS = 8, 16

# Element ids of the EBML and Matroska specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION = 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool


def vint(value: int, width: int = 0) -> bytes:
    """A size: as many leading zero bits as further bytes; all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes | int | str | float) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and body of a block of several frames."""
    if len(frames) == 1:
        return 0x00, frames[0]
    count, sizes, body = bytes([len(frames) - 1]), [len(f) for f in frames], b"".join(frames)
    if lacing == "fixed":
        return 0x04, count + body
    if lacing == "xiph":
        return 0x02, count + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + body
    steps = b""
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        steps += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, count + vint(sizes[0]) + steps + body


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


HEADER = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(EBML_MAX_ID, 4) + element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))))


def muxed(payload: bytes, lacing: str = "fixed") -> bytes:
    """A whole file of the payload's frames; timestamps in milliseconds."""
    step = FRAME * 1000 // RATE
    frames = len(payload) // FRAME
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, float(frames * step)) + element(MUXING_APP, "impactlens") + element(WRITING_APP, "impactlens"))
    parts, cues, at = [info, TRACK], [], len(info) + len(TRACK)
    for first in range(0, frames, LACE * BLOCKS):
        blocks = [element(TIMESTAMP, first * step)]
        for k in range(first, min(first + LACE * BLOCKS, frames), LACE):
            flags, body = laced([payload[i * FRAME : (i + 1) * FRAME] for i in range(k, min(k + LACE, frames))], lacing)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + ((k - first) * step).to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, first * step) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return HEADER + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def number(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length number and where it ends; keep: with its marker bit, as in ids. -1: unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value ^= 1 << 7 * width
        value = -1 if value == (1 << 7 * width) - 1 else value
    return value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Every element below at, masters before their children: id, start, start and end of its body."""
    ends = [(end, 0)]
    while ends:
        if at >= ends[-1][0]:
            ends.pop()
            continue
        start = at
        ident, at = number(data, at, keep=True)
        size, at = number(data, at)
        # A cluster of unknown size ends where the next one, or the cues, start.
        while ends[-1][1] == CLUSTER and ident in (CLUSTER, CUES, TRACKS, INFO):
            ends.pop()
        to = ends[-1][0] if size < 0 else at + size
        yield ident, start, at, to
        if ident in MASTERS:
            ends.append((to, ident if size < 0 else 0))
        else:
            at = to


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and frames' byte ranges of a block's body."""
    track, at = number(data, at)
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags & 0x06
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes = []
    if lacing == 0x02:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
            sizes.append(size)
    elif lacing == 0x06:
        size, at = number(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            step, at = number(data, at)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, relative, flags, ranges


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """The packet table, and the cues: time, track, absolute position of the cluster."""
    found, cues, clock, base, lasts = [], [], 0, 0, {}
    time = track = 0
    entry = 0
    for ident, _, at, to in elements(data, 0, len(data)):
        if ident == SEGMENT:
            base = at
        elif ident == TRACK_NUMBER:
            entry = int.from_bytes(data[at:to], "big")
        elif ident == DEFAULT_DURATION:
            lasts[entry] = int.from_bytes(data[at:to], "big") // 1_000_000
        elif ident == TIMESTAMP:
            clock = int.from_bytes(data[at:to], "big")
        elif ident in (SIMPLE_BLOCK, BLOCK):
            number_, relative, flags, ranges = frames_of(data, at, to)
            step = lasts.get(number_, 0)
            found += [Packet(number_, clock + relative + k * step, a, n, ident == SIMPLE_BLOCK and flags & 0x80 > 0) for k, (a, n) in enumerate(ranges)]
        elif ident == CUE_TIME:
            time = int.from_bytes(data[at:to], "big")
        elif ident == CUE_TRACK:
            track = int.from_bytes(data[at:to], "big")
        elif ident == CUE_CLUSTER_POSITION:
            cues.append((time, track, base + int.from_bytes(data[at:to], "big")))
    return found, cues


def feature(payload: bytes, table: list[Packet], cues: int) -> str:
    """Packets, cues, duration, and the signal's mean, mean square and sign changes, as whole numbers."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"packets={len(table)};cues={cues};ms={table[-1].timestamp + FRAME * 1000 // RATE if table else 0};mean1000={int(samples.sum()) * 1000 // len(samples)};square={int((samples * samples).sum()) // len(samples)};turns={turns}"


def stored_texts(df: DataFrame, lacing: str = "fixed") -> DataFrame:
    """doc_id, n_bytes, media (the file) for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or b"" for x in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([muxed(padded(x), lacing) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of every file: doc_id, packet, track, timestamp, offset, size, keyframe."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            for doc_id, data in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                found, _ = packets(data.as_py())
                cols = [*zip(*found, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())],
                    names=["doc_id", "packet", "track", "timestamp", "offset", "size", "keyframe"],
                )

    return media.mapInArrow(rows, "doc_id long, packet long, track long, timestamp long, offset long, size long, keyframe boolean")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """What a file holds: its payload, cut out by the packets' byte ranges, summed up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out = []
            for data in batch.column("media").to_pylist():
                table, cues = packets(data)
                payload = b"".join([data[p.offset : p.offset + p.size] for p in table])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, table, len(cues))))
            a, b, c, d, e, f = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(a, pa.int64()), pa.array(b), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e), pa.array(f)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(rows, READ)


def query(spark, sf_dir: str) -> DataFrame:
    """The files are written to the shared folder as a Parquet column and read from there."""
    return read_back(stored(stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
