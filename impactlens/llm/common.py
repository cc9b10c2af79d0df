"""Shared pieces: shared-folder paths, Arrow slicing, vectorised word splitting and 64-bit word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
U64 = np.uint64
MASK64 = (1 << 64) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir). Only a local session, whose
    executors are the driver, gets a folder of its own if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/impactlens-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/impactlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for these frames; nothing that is still to be computed may read them."""
    for frame in frames:
        hadoop = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        hadoop.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


#: What a worker process remembers between tasks, by the operator that does, and how it is forgotten.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[owner] = forget


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, for mapInArrow: workers are used again by other tasks, so what other operators remember is forgotten when a
    task begins, and free memory goes back to the system when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, forget in _REMEMBERED.items():
            if other != owner:
                forget()
        try:
            yield from rows(batches)
        finally:
            released()

    return run


def released() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0, one more than rows) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece has about `most` bytes of text, or one row."""
    for batch in batches:
        offsets = utf8(batch.column(column))[1]
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def class_table(ranges: list[tuple[int, int]], member: bool = True) -> np.ndarray:
    """256 booleans: member for the byte ranges given, else the opposite."""
    table = np.full(256, not member)
    for first, last in ranges:
        table[first : last + 1] = member
    return table


#: Words `[^\x20\x09-\x0D]+` over UTF-8 bytes.
NOT_BLANK = class_table([(0x20, 0x20), (0x09, 0x0D)], member=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in data, and each row's first word (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n; tables that a slice of usual length needs are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    up, down = np.full(n, BASE, U64), np.full(n, BASE_INVERSE, U64)
    up[0] = down[0] = 1
    tables = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    if n <= 2 * SLICE_BYTES:
        _POWERS[:] = tables
    return tables


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, with A-Z lower-cased if asked for; never 0."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    room = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(room)
    codes = BYTE_CODES[LOWER] if lower else BYTE_CODES
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(codes[data] * up[: len(data)], dtype=U64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    value = splitmix(value + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.where(value == 0, U64(1), value)


def one_word_hash(word: bytes, lower: bool = True) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]), lower)[0])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of count entries for each pair, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - before, counts)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
