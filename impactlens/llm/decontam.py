"""Benchmark decontamination: suffix arrays of the training documents, searched with every benchmark suffix.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased. A shard is a slice of the
documents. Its suffix array orders all its word positions by what follows them in their document (prefix doubling; in
each round only what is still tied is sorted). Every suffix of every benchmark item narrows the array's interval word by
word, by binary search, until a whole window has been matched: the interval holds all places where that window occurs.
Occurrences that follow each other on one alignment of document and item are put together to the longest verbatim
matches, with their places in both.

Semantics
- A window is `window` consecutive words of an item; a shorter item that has words is one window as a whole.
- Items of one id, given in several rows, are one item; a null id is called `null`. Positions in an item count from the
  beginning of its row.
- Null and empty texts have no words and no hits. Repeated documents are judged alike; extra columns are ignored by
  `judge` and kept by `clean`. An empty table gives an empty result; without items nothing is hit.
- The items are read in blocks of at most `block_words` words, so that what goes to the executors is bounded whatever
  the benchmark's size; each block is a pass over the documents that adds to what was found before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from impactlens.llm.common import class_table, discard, ragged, slices, stored, tidy, utf8, word_bounds, word_hashes

ALNUM = class_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], member=False)
WINDOW = 10
BLOCK_WORDS = 2_000_000


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and each row's first word."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), first


class Items:
    """A block of benchmark items: their words as numbers into a vocabulary, and the suffixes to be searched."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        words, first = hashed(pa.array(texts, pa.string()))
        self.window = window
        self.ids = sorted(set(ids))
        number = {k: i for i, k in enumerate(self.ids)}
        self.vocabulary, self.words = np.unique(words, return_inverse=True)
        lengths = np.diff(first)
        row = np.repeat(np.arange(len(ids)), lengths)
        place = np.arange(len(words)) - first[row]
        left = lengths[row] - place
        # A suffix that holds a whole window, or the whole of a shorter item.
        self.at = np.flatnonzero((left >= window) | ((place == 0) & (lengths[row] < window)))
        self.row, self.place, self.length = row[self.at], place[self.at], np.minimum(left[self.at], window)
        self.item = np.array([number[k] for k in ids], np.int64)[self.row]


def suffix_array(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions in the order of codes[position : end[position]]. Codes are 1 and up. Equal suffixes stand in any order."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = codes[order][1:] != codes[order][:-1]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)  # the first place of those that are equal so far
    rank[order] = np.repeat(starts, sizes)
    todo = order[np.repeat(sizes > 1, sizes)]
    known = 1
    while len(todo):
        then = todo + known
        after = np.where(then < end[todo], rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[todo] * (n + 1) + after
        sort = np.argsort(key)
        todo, key, after = todo[sort], key[sort], after[sort]
        group = rank[todo]
        begin = np.ones(len(todo), bool)
        begin[1:] = group[1:] != group[:-1]
        inside = np.arange(len(todo))
        place = group + inside - np.maximum.accumulate(np.where(begin, inside, 0))
        order[place] = todo
        fresh = np.ones(len(todo), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(todo)))
        rank[todo] = np.repeat(place[starts], sizes)
        todo = todo[np.repeat(sizes > 1, sizes) & (after > 0)]  # those with nothing after them are equal
        known *= 2
    return order


class Shard:
    """Documents' words with their suffix array."""

    def __init__(self, column: pa.Array):
        words, self.first = hashed(column)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        self.codes = codes.astype(np.int64) + 1
        self.document = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.end = self.first[1:][self.document]
        self.order = suffix_array(self.codes, self.end)

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, code: np.ndarray, after: bool) -> np.ndarray:
        """In each interval, whose suffixes agree in `depth` words, the first place of a suffix whose next word is not
        below `code`, or is above it."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            at = self.order[middle]
            next_ = np.where(at + depth < self.end[at], self.codes[np.minimum(at + depth, len(self.codes) - 1)], 0)
            below = next_ <= code[open_] if after else next_ < code[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low

    def occurrences(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """All places where a suffix's window occurs: positions in the shard, and numbers of suffixes."""
        found = np.minimum(np.searchsorted(self.vocabulary, items.vocabulary), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[found] == items.vocabulary if len(self.vocabulary) else np.zeros(len(items.vocabulary), bool)
        code = np.where(known, found + 1, -1)[items.words]  # no word of the shard is -1
        low, high = np.zeros(len(items.at), np.int64), np.full(len(items.at), len(self.codes))
        alive = np.arange(len(items.at))
        for depth in range(items.window):
            alive = alive[(items.length[alive] > depth) & (low[alive] < high[alive])]
            if not len(alive):
                break
            word = code[items.at[alive] + depth]
            lowest = self.bound(low[alive], high[alive], depth, word, False)
            highest = self.bound(lowest, high[alive], depth, word, True)
            low[alive], high[alive] = lowest, np.where(word < 0, lowest, highest)
        many = np.maximum(high - low, 0)
        return self.order[ragged(low, many)], np.repeat(np.arange(len(items.at)), many)


RESULT = "n_words long, spans array<struct<first:int,last:int>>, items array<string>, matches array<struct<item_id:string,item_start:int,doc_start:int,words:int>>"
SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])


def lists(kind: pa.DataType, columns: list, bounds: np.ndarray) -> pa.Array:
    """A list column of structs, or of one plain column."""
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)) if pa.types.is_struct(kind) else pa.array(columns[0], kind)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def runs(shard: Shard, places: np.ndarray, suffix: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences put together: position, suffix and words of each longest match, by document and position."""
    if not len(places):
        return places, suffix, places
    line = np.lexsort((places, places - items.place[suffix], items.row[suffix]))
    p, s = places[line], suffix[line]
    new = np.ones(len(p), bool)
    same = (items.row[s][1:] == items.row[s][:-1]) & (shard.document[p][1:] == shard.document[p][:-1])
    new[1:] = ~(same & (p[1:] - p[:-1] == 1) & (items.place[s][1:] - items.place[s][:-1] == 1))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(p)) - 1
    words = p[last] + items.length[s[last]] - p[begin]
    by = np.lexsort((items.place[s[begin]], items.item[s[begin]], p[begin]))
    return p[begin][by], s[begin][by], words[by]


def judged(items: Items, batches: Iterator[pa.RecordBatch], again: bool, more: bool) -> Iterator[pa.RecordBatch]:
    """doc_id and RESULT for each row. again: rows have those of other items, which count too; more: text is kept."""
    for batch in slices(batches):
        shard = Shard(batch.column("text"))
        places, suffix = shard.occurrences(items)
        n, words = batch.num_rows, len(shard.codes)
        edge = np.zeros(words + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + items.length[suffix], -1)
        marked = np.cumsum(edge) > 0
        if again:
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                for span in spans:
                    marked[shard.first[i] + span["first"] : shard.first[i] + span["last"]] = True
        # Runs of hit words, which end where their document does.
        turn = np.diff(np.concatenate([[False], marked[:words], [False]]).astype(np.int8))
        inner = shard.first[1:-1]
        inner = inner[(inner > 0) & (inner < words)]
        inner = np.unique(inner[marked[inner] & marked[inner - 1]])
        begin, stop = np.sort(np.append(np.flatnonzero(turn == 1), inner)), np.sort(np.append(np.flatnonzero(turn == -1), inner))
        head = shard.first[shard.document[begin]] if len(begin) else np.zeros(0, np.int64)
        spans = lists(SPAN, [begin - head, stop - head], np.searchsorted(begin, shard.first))
        pair = np.unique(shard.document[places] * max(1, len(items.ids)) + items.item[suffix]) if len(places) else np.zeros(0, np.int64)
        whose, which = pair // max(1, len(items.ids)), pair % max(1, len(items.ids))
        named = lists(pa.string(), [[items.ids[i] for i in which]], np.searchsorted(whose, np.arange(n + 1)))
        at, own, size = runs(shard, places, suffix, items)
        head = shard.first[shard.document[at]] if len(at) else np.zeros(0, np.int64)
        columns = [[items.ids[i] for i in items.item[own]], items.place[own], at - head, size]
        matches = lists(MATCH, columns, np.searchsorted(at, shard.first))
        if again:
            named = pa.array([sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), named.to_pylist(), strict=True)], pa.list_(pa.string()))
            matches = pa.array([a + b for a, b in zip(batch.column("matches").to_pylist(), matches.to_pylist(), strict=True)], pa.list_(MATCH))
        out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(shard.first)), "spans": spans, "items": named, "matches": matches}
        yield pa.RecordBatch.from_pydict(out | ({"text": batch.column("text")} if more else {}))


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[tuple[Items, bool]]:
    """The items in blocks of bounded size, streamed to the driver; and whether more follow."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("id").toLocalIterator():
        if texts and size + len(row["text"]) // 2 > block_words:
            yield Items(ids, texts, window), True
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"]) // 2 + 1
    yield Items(ids, texts, window), False


def total(spans: Column) -> Column:
    """Words in spans that don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), longest_match, spans (hit words) and matches (longest verbatim
    ones: item_id, item_start, doc_start, words) for each row of docs."""
    found, last = docs.select(F.col("doc_id").cast("long"), "text"), None
    for items, more in blocks(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        rows = lambda it, shared=shared, again=last is not None, more=more: judged(shared.value, it, again, more)
        found = found.mapInArrow(tidy(rows), f"doc_id long, {RESULT}" + (", text string" if more else ""))
        if more:  # what follows reads it again; a block's workers end with its pass
            before, last = last, stored(found, "judged")
            found = last
            if before is not None:
                discard(before)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", total(F.col("spans")).alias("n_hit"), "items", longest.alias("longest_match"), "spans", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without a hit, with their own columns."""

    def kept(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shard = Shard(batch.column("text"))
            hit = np.zeros(batch.num_rows, bool)
            hit[shard.document[shard.occurrences(items)[0]]] = True
            yield batch.filter(pa.array(~hit))

    out, last = docs, None
    for items, more in blocks(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = out.mapInArrow(tidy(lambda it, shared=shared: kept(shared.value, it)), StructType(docs.schema.fields))
        if more:
            before, last = last, stored(out, "clean")
            out = last
            if before is not None:
                discard(before)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match",
    )
