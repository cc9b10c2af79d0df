"""Token ids as Simple-8b segments.

Texts become token ids; ids are packed in blocks of `BLOCK` into 64-bit words whose top four bits say how many ids of
how many bits the word holds. An id that no selector can hold stands in a word of its own after an escape word. Per
block, the offset of its first word is kept, so that any block is decoded alone, and all blocks together without loops
over ids. A file segment holds a run of documents: how many, the number of ids before them in their part, their doc_ids,
their counts of ids (Simple-8b, too) and their ids.

Semantics
- A text's ids are the tokenizer's, without special tokens added, then `end`. Null is an empty text: `end` alone.
- Documents stand in ascending doc_id order, nulls first, rows of equal doc_id by a hash of their text. Repeated rows are
  all written, and may stand in several parts.
- With a tokenizer whose normaliser and splitter are those below, texts are cut at ASCII white space and each distinct
  piece is encoded once: that splitter drops white space and never joins across it. Any other gets whole texts.
- An empty table makes no segment and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.llm.common import NOT_BLANK, U64, ragged, remembers, shared_path, slices, tidy, utf8, word_bounds, word_hashes

END = 2
BLOCK = 1024
MAGIC, FILE_MAGIC = b"S8B1", b"S8F1"
#: Fixed values of the format: ids a word and bits an id, by selector; selector 0 is the escape.
SELECTORS = [(0, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: Text bytes that make a segment, and distinct pieces and stems that a worker remembers.
SEGMENT_BYTES, REMEMBERED, REMEMBERED_STEMS, FRESH = 1 << 20, 1_000_000, 250_000, 1 << 15
#: ASCII punctuation that ends a piece and is a word of its own there; an apostrophe may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: The normaliser and the splitter that drop white space, and split letters, digits and other marks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and each block's first word (one more than blocks)."""
    ids = np.ascontiguousarray(ids, U64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(1, np.int64)
    # How many ids a word that starts here holds, and its selector; the widest ids first, each longer run replaces it.
    end = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    place = np.arange(n)
    run, kind = np.ones(n, np.int32), np.zeros(n, np.int8)
    wide = np.zeros(n + 1, np.int32)
    top = int(ids.max())
    for selector in range(15, 0, -1):
        count, bits = SELECTORS[selector]
        if selector > 1 and top >> SELECTORS[selector - 1][1] == 0:
            continue  # all ids fit the next one too, and more of them
        np.cumsum(ids >= U64(1 << bits), dtype=np.int32, out=wide[1:])
        stop = np.minimum(place + count, end)
        fits = np.flatnonzero(wide[stop] == wide[:-1])
        long_ = stop[fits] - fits
        run[fits], kind[fits] = long_, selector
        if not (long_ == count).any():
            break  # a longer run of smaller ids would hold one of these
    # Word starts: all blocks walk together.
    starts_of, at = [], np.arange(blocks) * BLOCK
    lane, last = np.arange(blocks), np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    lanes = []
    while len(at):
        starts_of.append(at)
        lanes.append(lane)
        at = at + run[at]
        go = at < last[lane]
        at, lane = at[go], lane[go]
    starts = np.sort(np.concatenate(starts_of))
    kinds, runs = kind[starts], run[starts]
    size = np.where(kinds == 0, 2, 1)
    first = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(first[-1], U64)
    for selector in np.unique(kinds):
        own = np.flatnonzero(kinds == selector)
        if selector == 0:
            words[first[own] + 1] = ids[starts[own]]
            continue
        count, bits = SELECTORS[selector]
        word = np.full(len(own), int(selector) << 60, U64)
        if bits:
            for k in range(count):
                have = runs[own] > k
                word[have] |= ids[starts[own][have] + k] << U64(bits * k)
        words[first[own]] = word
    begins = np.searchsorted(starts, np.arange(blocks) * BLOCK)
    return words, np.append(first[begins], first[-1])


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks."""
    out = np.zeros(n, U64)
    if not n:
        return out
    kinds = (words >> U64(60)).astype(np.int64)
    escapes = np.flatnonzero(kinds == 0)
    # A word after an escape is verbatim and may look like another escape: only every other one of a row is real.
    if len(escapes):
        real, skip = [], -1
        for e in escapes.tolist():
            if e != skip:
                real.append(e)
                skip = e + 1
        verbatim = np.array(real) + 1
        whole = np.ones(len(words), bool)
        whole[verbatim] = False
    else:
        verbatim, whole = np.zeros(0, np.int64), np.ones(len(words), bool)
    counts = np.array([1, *(c for c, _ in SELECTORS[1:])])[kinds]
    counts[~whole] = 0
    # Ids before each word, within its block; a block's last word may be filled only in part.
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.cumsum(counts) - counts
    start = block * BLOCK + before - before[offsets[block]]
    stop = np.minimum((block + 1) * BLOCK, n)
    out[start[verbatim - 1]] = words[verbatim]
    for selector in np.unique(kinds[whole]):
        if selector == 0:
            continue
        count, bits = SELECTORS[selector]
        if not bits:
            continue
        own = np.flatnonzero(whole & (kinds == selector))
        mask = U64((1 << bits) - 1)
        for k in range(count):
            to = start[own] + k
            have = to < stop[own]
            out[to[have]] = (words[own[have]] >> U64(bits * k)) & mask
    return out


def segment(ids: np.ndarray) -> bytes:
    """Header (magic, ids, words, blocks), block offsets, words; little-endian."""
    words, offsets = pack(ids)
    return MAGIC + np.array([len(ids), len(words), len(offsets) - 1], "<u8").tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def ids_of(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("no Simple-8b segment")
    n, words, blocks = np.frombuffer(data, "<u8", 3, 4).astype(int).tolist()
    offsets = np.frombuffer(data, "<u4", blocks + 1, 28).astype(np.int64)
    return unpack(np.frombuffer(data, "<u8", words, 28 + 4 * (blocks + 1)).astype(U64), offsets, n)


def file_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, start: int) -> bytes:
    """Header (magic, documents, start, bytes of the counts), which ids are null, doc_ids, counts, ids."""
    packed_ = segment(counts)
    header = FILE_MAGIC + np.array([len(doc_ids), start, len(packed_)], "<u8").tobytes()
    return header + np.array([d is None for d in doc_ids], bool).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + packed_ + segment(ids)


def documents_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, which of them are null, counts, ids, start."""
    if data[:4] != FILE_MAGIC:
        raise ValueError("no segment of documents")
    n, start, size = np.frombuffer(data, "<u8", 3, 4).astype(int).tolist()
    at = 28 + 9 * n
    return np.frombuffer(data, "<i8", n, 28 + n), np.frombuffer(data, bool, n, 28), ids_of(data[at : at + size]).astype(np.int64), ids_of(data[at + size :]), start


def letters_only(text: str) -> bool:
    """Whether text is letters, also when it is normalised and lower-cased: some letters turn into one and a mark."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


class Ragged:
    """Rows of ids, one after the other; they grow in place, in arrays that double."""

    def __init__(self):
        self.many, self.flat, self.starts = 0, np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64)

    def __len__(self) -> int:
        return self.many

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        at, n = int(self.starts[self.many]), self.many + len(counts)
        if at + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (at + len(flat)))
        if n + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (n + 1))
        self.flat[at : at + len(flat)] = flat
        self.starts[self.many + 1 : n + 1] = at + np.cumsum(counts, dtype=np.int64)
        self.many = n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.starts[rows + 1] - self.starts[rows]
        return self.flat[ragged(self.starts[rows], counts)], counts


class Encoder:
    """Ids of texts; remembers those of distinct pieces by their hash, and those of the stems that many pieces share: a
    piece that is letters and then punctuation marks is two words to the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_piece = config["normalizer"] == NORMALIZER and config["pre_tokenizer"] == SPLITTER and config["post_processor"] is None
        self.by_stem = self.by_piece and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
        self.forget()
        self.stems: dict[str, list[int]] = {}

    def forget(self) -> None:
        # Hashes and rows, ascending; what is new stands apart until there is much of it.
        self.known = self.fresh = np.zeros(0, U64)
        self.row = self.fresh_row = np.zeros(0, np.int64)
        self.pieces = Ragged()

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if it isn't known."""
        out = np.full(len(hashes), -1)
        for known, row in ((self.known, self.row), (self.fresh, self.fresh_row)):
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                out[hit] = row[place[hit]]
        return out

    def remember(self, hashes: np.ndarray) -> None:
        """Gives the next rows to hashes, which ascend."""
        place = np.searchsorted(self.fresh, hashes)
        self.fresh_row = np.insert(self.fresh_row, place, len(self.pieces) + np.arange(len(hashes)))
        self.fresh = np.insert(self.fresh, place, hashes)
        if len(self.fresh) > FRESH:
            place = np.searchsorted(self.known, self.fresh)
            self.known, self.row = np.insert(self.known, place, self.fresh), np.insert(self.row, place, self.fresh_row)
            self.fresh, self.fresh_row = self.fresh[:0], self.fresh_row[:0]

    def stem(self, stem: str) -> list[int]:
        ids = self.stems.get(stem)
        if ids is None:
            if stem.isascii() and stem.isalpha():  # others are normalised by the library alone
                ids = [t.id for t in self.tokenizer.model.tokenize(stem.lower())]
            else:
                ids = self.tokenizer.encode(stem, add_special_tokens=False).ids
            self.stems[stem] = ids
        return ids

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces, whose hashes ascend."""
        if len(self.stems) > REMEMBERED_STEMS:
            self.stems = {}
        flat: list[int] = []
        ends = []
        for text in map(bytes.decode, pieces):
            if self.by_stem:
                stem = text.rstrip(MARKS)
                if stem is not text and not (stem and letters_only(stem)):
                    stem = text
                flat += self.stem(stem.lower() if stem.isascii() and stem.isalpha() else stem)
                if len(stem) < len(text):
                    flat += self.stem(text[len(stem) :])
            else:
                flat += self.tokenizer.encode(text, add_special_tokens=False).ids
            ends.append(len(flat))
        self.remember(hashes)
        self.pieces.add(np.array(flat, np.int32), np.diff(np.array([0, *ends])))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with end after each text, and the count of each text."""
        if not self.by_piece:
            found = [[*e.ids, end] for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)
        data, offsets = utf8(column)
        starts, ends, first = word_bounds(data, offsets, NOT_BLANK)
        distinct, at, index = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.pieces) + len(distinct) > REMEMBERED:
            self.forget()
        row = self.found(distinct)
        new = row < 0
        if new.any():
            whole = data.tobytes()
            row[new] = len(self.pieces) + np.arange(int(new.sum()))
            self.learn(distinct[new], [whole[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        ids, counts = self.pieces.take(row[index]) if len(distinct) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts)])[first]
        return np.insert(ids, bounds[1:], end), np.diff(bounds) + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


remembers("tokens", encoder.cache_clear)
SEGMENTS = "part int, n_ids long, data binary"


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> None:
    """Segments of docs in ascending doc_id order, as a Parquet column; a partition's segments are numbered by range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in slices(batches, most=SEGMENT_BYTES):
            ids, counts = own.encode(batch.column("text"), end)
            data = file_segment(batch.column("doc_id").to_pylist(), counts, ids, start)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "n_ids", "data"])
            start += len(ids)

    n = max(1, docs.rdd.getNumPartitions())
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    # Ties are dealt out, too: no id and no repeated row has to fit one partition.
    ordered = keyed.repartitionByRange(n, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    ordered.mapInArrow(tidy(rows, "tokens"), SEGMENTS).write.option("compression", "zstd").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, all decoded from the segments. Only a sum per partition
    comes to the driver."""
    segments = spark.read.parquet(folder)
    before, total = {}, 0
    for row in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[row["part"]], total = total, total + row["n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part"), batch.column("data"), strict=True):
                doc_ids, none, counts, ids, start = documents_of(data.as_py())
                ids = ids.astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(counts)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                first = before[part.as_py()] + start
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=none), pa.array(first + bounds[:-1]), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(tidy(rows, "tokens"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes docs' ids below the shared folder and reads them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer or default_tokenizer(), end)
    return read(docs.sparkSession, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
