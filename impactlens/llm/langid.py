"""Language identification by cross-parsing entropy.

A suffix automaton is built of labelled text for each language. A text is parsed against every language: a phrase is the
longest match that begins where the last phrase ended; a letter that the automaton lacks is a phrase of its own. The
language for which phrases * log2(training length) / characters is least wins. Automata stand in one sparse table (row
displacement: an edge has a slot, and nothing is kept for those that are missing). Texts are cut in blocks of `BLOCK`
letters that step through the table together, from the root at first; a block whose predecessor ends in another state is
parsed again from there, until no block's first state changes. So the phrases are those of the whole text, at any `BLOCK`.

Semantics
- Letters are lower-cased; each run of anything else is one separator. The whole text counts.
- Null texts and texts without a letter are `und` with score 0; so is every text if nothing could be learned.
- score = (second least entropy - least) / second least; 1 with a single language. Ties: the first by code point.
- Learned from about `PIECES` pieces a language, of `PIECE` characters each, picked by hash from anywhere in the labelled
  texts; never from rows that `train` excludes, nor from null lang. Only text and lang are read, and doc_id for the split.
  There may be `MOST_LANGUAGES` at most. An empty table gives an empty result; repeated rows agree; extra columns are
  kept or replaced by name.
- `accepted` keeps the rows in a wanted language that the text fits: one that is coded in at most `UNFIT` of the bits
  that single letters would take is in that language, and short texts get `SLACK` bits more.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from impactlens.llm.common import ragged, remembers, slices, tidy, utf8

BLOCK = 512
PIECES, PIECE, MOST_LANGUAGES = 64, 400, 1000
UNFIT, SLACK = 0.9, 60.0
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


remembers("langid", letters.cache_clear)


def automaton(word: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of word: each state's edges, by symbol; state 0 is the root."""
    rows: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in word:
        now = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = now
            p = link[p]
        if p != -1:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return rows


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """base by state, and slots: state * 2^32 + target at base + symbol for each edge, -1 elsewhere. Any base + symbol is
    a slot. States of several edges look for a base at random, while half of the slots stay free; those of one take what
    is left."""
    edges = sum(map(len, rows))
    size = 2 * edges + 2 * width
    slots = np.full(size, -1, np.int64)
    base = np.full(len(rows), width, np.int64)
    rng = np.random.default_rng(1)
    for state in sorted((k for k in range(len(rows)) if len(rows[k]) > 1), key=lambda k: -len(rows[k])):
        symbols = np.fromiter(rows[state], np.int64, len(rows[state]))
        targets = np.fromiter(rows[state].values(), np.int64, len(symbols))
        while True:
            tries = rng.integers(0, size - width, 8)
            free = np.flatnonzero((slots[tries[:, None] + symbols] < 0).all(1))
            if len(free):
                break
        base[state] = tries[free[0]]
        slots[base[state] + symbols] = (state << 32) | targets
    single = np.array([k for k in range(len(rows)) if len(rows[k]) == 1], np.int64)
    symbols = np.array([next(iter(rows[k])) for k in single.tolist()], np.int64)
    targets = np.array([next(iter(rows[k].values())) for k in single.tolist()], np.int64)
    free = np.flatnonzero(slots < 0)
    free = free[(free >= width) & (free < size - width)][: len(single)]
    base[single] = free - symbols
    slots[free] = (single << 32) | targets
    return base, slots


class Model:
    """The automata of all languages, states and slots numbered through."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        lower = letters()
        coded = {k: [lower[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)] for t in v] for k, v in samples.items()}
        alphabet = np.unique(np.concatenate([np.zeros(1, np.int32), *(x for v in coded.values() for x in v)]))
        self.known = alphabet[alphabet > 0]
        # 0: separator; 1..n: known letters; n + 1: other letters; n + 2: end of a text; n + 3: between samples.
        n = len(self.known)
        self.other, self.end, between = n + 1, n + 2, n + 3
        width = n + 4
        bases, slots, roots, jumps, misses, lengths, own = [], [], [], [], [], [], []
        states = room = 0
        for name in self.languages:
            word: list[int] = []
            for x in coded[name]:
                word += self.classes(x).tolist() + [between]
            rows = automaton(word)
            base, slot = displaced(rows, width)
            bases.append(base + room)
            slots.append(np.where(slot < 0, -1, slot + ((states << 32) | states)))
            jump = np.full(width, states)
            jump[list(rows[0])] = np.array(list(rows[0].values()), np.int64) + states
            jump[[self.end, between]] = states
            jumps.append(jump)
            miss = np.ones(width, np.int64)
            miss[[*rows[0], self.end]] = 0
            misses.append(miss)
            roots.append(states)
            lengths.append(len(word))
            own.append(len({c for c in word if c != between}) + 1)
            states, room = states + len(rows), room + len(slot)
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.base, self.slots = joined(bases, np.int64), joined(slots, np.int64)
        self.roots, self.width = np.array(roots, np.int64), width
        #: Where a letter leads, and the phrases that it makes, where no phrase goes on; by language and symbol.
        self.jump, self.miss = joined(jumps, np.int64), joined(misses, np.int64)
        self.bits = np.log2(np.array(lengths, np.float64) + 1)
        self.letter_bits = np.log2(np.array(own, np.float64))

    def classes(self, lowered: np.ndarray) -> np.ndarray:
        """Symbols of lowered code points, runs of separators as one, none at the start."""
        place = np.minimum(np.searchsorted(self.known, lowered), max(0, len(self.known) - 1))
        known = self.known[place] == lowered if len(self.known) else np.zeros(len(lowered), bool)
        symbol = np.where(lowered == 0, 0, np.where(known, place + 1, self.other))
        keep = symbol > 0
        keep[1:] |= symbol[:-1] > 0
        return symbol[keep]

    def lookup(self) -> np.ndarray:
        """Symbol by code point."""
        table = np.where(letters() > 0, self.other, 0).astype(np.int32)
        place = np.searchsorted(self.known, letters())
        place = np.minimum(place, max(0, len(self.known) - 1))
        if len(self.known):
            hit = self.known[place] == letters()
            table[hit] = place[hit] + 1
        return table

    def steps(self, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last state and phrases ended, by language and lane. grid: a row for each place, a column for each lane."""
        state = np.ascontiguousarray(state)
        ended = np.zeros(state.size, np.int64)
        lanes, index, slot = state.shape[1], np.empty_like(state), np.empty_like(state)
        for row in grid:
            np.take(self.base, state, out=index, mode="clip")
            index += row
            np.take(self.slots, index, out=slot, mode="clip")
            lost = np.flatnonzero((slot >> 32) != state)
            language = lost // lanes
            by = language * self.width + row[lost - language * lanes]
            ended[lost] += (state.ravel()[lost] != self.roots[language]) + self.miss[by]
            state = slot & 0xFFFFFFFF
            state.ravel()[lost] = self.jump[by]
        return state, ended.reshape(state.shape)

    def parse(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by language and text, for texts of the given lengths one after the other."""
        many = np.maximum(1, -(-lengths // BLOCK))
        first = np.concatenate([[0], np.cumsum(many)])
        lanes = int(first[-1])
        grid = np.full(lanes * BLOCK, self.end, np.int64)
        grid[ragged(first[:-1] * BLOCK, lengths)] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK)[:, : min(BLOCK, int(lengths.max(initial=0)))].T)
        begins = np.zeros(lanes + 1, bool)
        begins[first] = True
        entry = np.repeat(self.roots[:, None], lanes, 1)
        leave, ended = self.steps(grid, entry)
        while True:
            before = np.concatenate([entry[:, :1], leave[:, :-1]], 1)
            again = np.flatnonzero(~begins[:-1] & (before != entry).any(0))
            if not len(again):
                break
            entry[:, again] = before[:, again]
            leave[:, again], ended[:, again] = self.steps(grid[:, again], entry[:, again])
        ended += (leave != self.roots[:, None]) & begins[1:]  # the phrase that is open at the text's end
        total = np.concatenate([np.zeros((len(self.roots), 1), np.int64), np.cumsum(ended, 1)], 1)
        return total[:, first[1:]] - total[:, first[:-1]]


def judged(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with each row's language and score, and whether it fits that language."""
    table = model.lookup()
    names = np.array([*model.languages, UND], object)
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        symbols = table[points]
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        begins = heads[:-1][heads[:-1] < heads[1:]]
        keep[begins] = symbols[begins] > 0
        kept = np.concatenate([[0], np.cumsum(keep)])[heads]
        lengths = np.diff(kept)
        some = np.concatenate([[0], np.cumsum(symbols > 0)])[heads]
        some = np.diff(some) > 0
        best, score, fits = np.full(len(lengths), len(names) - 1), np.zeros(len(lengths)), np.zeros(len(lengths), bool)
        if len(model.languages) and some.any():
            bits = model.parse(symbols[keep], lengths) * model.bits[:, None]
            entropy = bits / np.maximum(lengths, 1)
            order = np.sort(entropy, 0)
            margin = (order[1] - order[0]) / np.maximum(order[1], 1e-12) if len(order) > 1 else np.ones(len(lengths))
            least = entropy.argmin(0)
            best, score = np.where(some, least, best), np.where(some, margin, 0.0)
            fits = some & (bits.min(0) <= UNFIT * lengths * model.letter_bits[least] + SLACK)
        yield batch, names[best], score, fits


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> Model:
    """Two passes: pieces of labelled texts are counted by language, then a hash picks about `pieces` of each, wherever in
    a text they stand. What comes to the driver is bounded by MOST_LANGUAGES and 1.5 * pieces * piece characters."""
    labelled = docs.where("lang is not null and text is not null").where(F.length("text") > 0)
    many = F.ceil(F.length("text") / piece).cast("int")
    counts = labelled.groupBy("lang").agg(F.sum(many).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model({})
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, pieces / r["n"])) for r in counts], "lang string, share double"))
    cut = labelled.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.explode(F.sequence(F.lit(0), many - 1)).alias("k"))
    pick = F.xxhash64("h", "k") / float(1 << 64) + 0.5
    sample = cut.withColumn("pick", pick).join(share, "lang").where(F.col("pick") < F.col("share"))
    rows = sample.select("lang", "pick", F.substring("text", F.col("k") * piece + 1, F.lit(piece)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["pick"], r["text"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, score, _ in judged(shared.value, batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidy(marked, "langid"), StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def accepted(docs: DataFrame, model: Model, wanted: Collection[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """The rows of docs that are in a wanted language (any that was learned, if none are named), fit it and have at least
    this score; docs' own columns."""
    names_wanted = frozenset(model.languages if wanted is None else wanted)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, score, fits in judged(shared.value, batches):
            own = np.fromiter((n in names_wanted for n in names), bool, len(names))
            yield batch.filter(pa.array(own & fits & (score >= least_score)))

    return docs.mapInArrow(tidy(kept, "langid"), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
