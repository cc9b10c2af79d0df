"""N-gram Jaccard join: all pairs of texts whose shingle sets have a Jaccard similarity of at least num / den.

1. A text's shingles (hashes of consecutive words) are a set ordered by hash, the global order. Texts with equal sets
   are one class; classes, not texts, are joined.
2. Classes meet through parts. For sets whose smaller one lies in a size band, the symmetric difference of a linked pair
   is at most H, so of H + 1 + S parts, into which the universe is hashed, they agree in at least S + 1. Each class
   leaves out the S parts that most classes share (passages that many texts have; ties by the part's hash; empty parts
   count among the S). Both classes of a linked pair order the parts in which they agree alike, so both leave out only
   a beginning of that order, and at least one part remains where they meet: no link is lost. A class that shares only
   S parts with others at all meets none.
3. Each part's members are tried against its least class, by a prefix tree: ordered sets share the tree's paths, a
   path's overlap with the probe is counted once, and a subtree is left when what remains of either set cannot reach the
   overlap that is needed. A class that meets very many is tried in several units. Classes linked so far are contracted.
4. Groups (a part's least class and those that met it) that are not one component yet are joined as a whole, in units
   of two blocks, again by prefix trees; a probe passes over what it is already connected with. Blocks hold classes of
   one size band; a component that fills blocks has its own, which never meet each other, and the others are mixed.
   Only ids are dealt out; sets are joined to the units that are left.

Semantics
- Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. With fewer than `words` words the whole
  sequence is the only shingle; null and blank texts have an empty set and are linked with nothing.
- `components` gives each row its set's size and the smallest doc_id that can be reached by links. Rows without doc_id
  take part, and count as larger than any id. Repeated rows are kept. An empty table gives an empty result; extra
  columns are ignored. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from impactlens.llm.common import NOT_BLANK, U64, discard, own_name, released, slices, splitmix, stored, tidy, utf8, word_bounds, word_hashes

#: Up to here a part's classes are counted; classes in a block and pairs in a unit; bits of the filter for step 3's sets;
#: salts of a group.
CROWD, BLOCK, FILTER_BITS, SALTS = 64, 256, 26, 64
#: A part row's band column: the band, and below it how many parts the class leaves out there.
ROOM_BITS = 22


@dataclass(frozen=True)
class Rule:
    """Sets x, y link when den * |x & y| >= num * |x | y|."""

    words: int = 3
    num: int = 90
    den: int = 100

    def needed(self, m, n):
        """The least overlap of linked sets of sizes m and n."""
        return -(-self.num * (m + n) // (self.num + self.den))

    def size_band(self, size: Column) -> Column:
        """A number for each set size; those of linked sets differ by one at most."""
        width = max(math.log(self.den / self.num) * (1 + 1e-9), 1e-9)
        return F.floor(F.log(size) / width)

    def bands(self, largest: int) -> list[tuple[int, int, int, int]]:
        """Smallest size, largest size, parts and S of each band up to a set size."""
        out, low = [], 1
        while low <= largest:
            top = max(low, low * 3 // 2)
            reach = top * self.den // self.num
            differ = (top + reach) * (self.den - self.num) // (self.den + self.num)
            spare = 0
            while differ and spare < min(differ // 16 + self.empty(low, differ + 1 + spare), 4 * (low + differ)):
                spare += max(1, differ // 16)
            out.append((low, reach, differ + 1 + spare, spare))
            low = top + 1
        return out

    @staticmethod
    def empty(size: int, many: int) -> float:
        """Of so many parts, those that a set of this size leaves empty, with four standard deviations."""
        load = size / many
        none = math.exp(-load)
        return many * none + 4 * math.sqrt(max(0.0, many * none * (1 - (1 + load) * none)))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and each row's first one."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets, NOT_BLANK)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    n = len(count)
    if not len(h):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    # A shingle starts at every word that has enough words after it, or at the first word of a short text.
    row = np.repeat(np.arange(n), count)
    place = np.arange(len(h)) - first[row]
    left = count[row] - place
    at = np.flatnonzero((left >= words) | (place == 0))
    value = np.zeros(len(at), U64)
    for k in range(words):
        have = left[at] > k
        value[have] = splitmix(value[have] * U64(0xD6E8FEB86659FD93) + h[at[have] + k])
    row = row[at]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(n + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[first[1:]] - total[first[:-1]]


def classes_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as signed; 0 for the empty set."""
    size = np.diff(first).astype(U64)
    mixed = splitmix(sums(splitmix(values ^ U64(0xA0761D6478BD642F)), first) + size)
    return np.where(size > 0, mixed | U64(1), U64(0)).astype(np.int64)


def sized(docs: DataFrame, rule: Rule) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, first = shingle_sets(batch.column("text"), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(classes_of(values, first))], names=["doc_id", "n_shingles", "class"])

    return docs.mapInArrow(tidy(rows), "doc_id long, n_shingles long, class long")


def parts(docs: DataFrame, rule: Rule) -> DataFrame:
    """part, class, band for each part of each class; a task tells each class only once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in slices(batches):
            values, first = shingle_sets(batch.column("text"), rule.words)
            named = classes_of(values, first).tolist()
            own = []
            for i, c in enumerate(named):
                if c and c not in told:
                    told.add(c)
                    own.append(i)
            if not own:
                continue
            own = np.array(own)
            size = np.diff(first)
            content = splitmix(values + U64(0x632BE59BD9B4E019))
            for band, (low, reach, many, spare) in enumerate(rule.bands(int(size[own].max()))):
                mine = own[(size[own] >= low) & (size[own] <= reach)]
                if not len(mine):
                    continue
                which = np.repeat(np.arange(len(mine)), size[mine])
                at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(len(which))
                # The part that a shingle is hashed into; a part's content is the sum of its shingles' mixed hashes.
                slot = which * many + (((values[at] >> U64(32)) * U64(many)) >> U64(32)).astype(np.int64)
                # Sets are ascending, and so are their slots.
                begins = np.ones(len(slot), bool)
                begins[1:] = slot[1:] != slot[:-1]
                begins = np.flatnonzero(begins)
                content_of = np.add.reduceat(content[at], begins)
                number = (slot[begins] % many).astype(U64)
                key = splitmix(content_of ^ splitmix(number * U64(0x9E3779B97F4A7C15) + U64(band + 1)))
                filled = slot[begins]
                whose = own_of = filled // many
                # Empty parts are not told, but count as left out; only a set with more than S of them tells them too.
                none = many - np.bincount(own_of, minlength=len(mine))
                for k in np.flatnonzero(none > spare).tolist():
                    vacant = np.setdiff1d(np.arange(many), filled[own_of == k] % many).astype(U64)
                    key = np.append(key, splitmix(splitmix(vacant * U64(0x9E3779B97F4A7C15) + U64(band + 1))))
                    whose = np.append(whose, np.full(len(vacant), k))
                who = np.array(named)[mine][whose]
                room = np.maximum(0, spare - none)[whose] + (band << ROOM_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(who), pa.array(room.astype(np.int32))], names=["part", "class", "band"])

    return docs.mapInArrow(tidy(rows), "part long, class long, band int")


def meetings(rows: DataFrame) -> DataFrame:
    """part, class, band and size (classes that share the part, at most CROWD + 1) for parts of several classes. A
    part's rows stand together in a sorted partition and stream by; those of a crowded one are not held."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        crowd: tuple[int, int] | None = None  # a crowded part that is still going on, and the last class told of it
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in ("part", "class", "band")]
            held = [np.concatenate(p) for p in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1], "left"))
            yield told([x[:last] for x in held], crowd)
            held = [x[last:] for x in held]
            part = int(held[0][0])
            if crowd is None or crowd[0] != part:
                crowd = (part, 0) if len(np.unique(held[1])) > CROWD else None
            if crowd is not None:
                yield told(held, crowd)
                crowd = (part, int(held[1][-1]))
                held = [x[:0] for x in held]
        yield told(held, crowd)

    def told(cols: list[np.ndarray], crowd: tuple[int, int] | None) -> pa.RecordBatch:
        part, cls, band = cols
        fresh = np.ones(len(part), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (cls[1:] != cls[:-1])
        begins = np.ones(len(part), bool)
        begins[1:] = part[1:] != part[:-1]
        first = np.flatnonzero(begins)
        size = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        if crowd is not None and len(part) and part[0] == crowd[0]:
            size[0] = CROWD + 1
            fresh &= (part != crowd[0]) | (cls != crowd[1])
        size = np.repeat(np.minimum(size, CROWD + 1), np.diff(np.append(first, len(part))))
        keep = fresh & (size > 1)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (part, cls, band, size)], names=["part", "class", "band", "size"])

    # Many more keys than partitions, and at most a row per class in each: no partition depends on one group.
    dealt = rows.repartition("part").sortWithinPartitions("part", "class")
    return dealt.mapInArrow(tidy(found), "part long, class long, band int, size long")


def candidates(docs: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs (a, b) of classes and the least class that shares one of the parts which are not left out."""
    met = stored(meetings(parts(docs, rule)), "join-parts")
    # A class has at most so many parts as a text has words in each band, so these windows are small.
    rank = F.row_number().over(Window.partitionBy("class", "band").orderBy(F.desc("size"), "part"))
    kept = met.withColumn("rank", rank).where(F.col("rank") > F.col("band").bitwiseAND((1 << ROOM_BITS) - 1))
    kept = stored(kept.select("part", "class"), "join-kept")
    discard(met)
    pivots = kept.groupBy("part").agg(F.min("class").alias("a"), F.max("class").alias("top")).where("a != top").select("part", "a")
    pairs = stored(kept.join(pivots, "part").where("a != class").select("a", F.col("class").alias("b")).distinct(), "join-pairs")
    discard(kept)
    return pairs


class PrefixTree:
    """Ordered sets in a path-compressed trie. A node is a run of one set's elements, and the range of sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        shared = [self._shared(a, b) for a, b in zip(self.sets[:-1], self.sets[1:], strict=True)]
        # (first set, past the last, from depth, to depth, children, sets that end here, least and greatest size)
        self.nodes: list[tuple] = []
        todo = [(0, len(self.sets), 0, -1)] if sets else []
        self.roots: list[int] = []
        while todo:
            low, high, depth, parent = todo.pop()
            sizes = [len(s) for s in self.sets[low:high]]
            to = min([min(sizes), *shared[low : high - 1]])
            node = len(self.nodes)
            ended = [i for i in range(low, high) if len(self.sets[i]) == to]
            self.nodes.append((low, high, depth, to, [], ended, min(sizes), max(sizes)))
            (self.nodes[parent][4] if parent >= 0 else self.roots).append(node)
            at = low + len(ended)  # the sets that end here sort first
            while at < high:
                end = at + 1
                while end < high and shared[end - 1] > to:
                    end += 1
                todo.append((at, end, to, node))
                at = end

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        at = int(differ.argmax()) if n else 0
        return at if n and differ[at] else n

    def probe(self, x: np.ndarray, rule: Rule, skip=None) -> list[int]:
        """The sets (by their number when added) that link with x. skip(number): not to be looked at."""
        found, n = [], len(x)
        todo = [(r, 0) for r in self.roots]
        while todo:
            node, overlap = todo.pop()
            low, high, depth, to, children, ended, least, most = self.nodes[node]
            if skip is not None and all(skip(self.order[i]) for i in range(low, high)):
                continue
            run = self.sets[low][depth:to]
            if len(run):
                place = np.searchsorted(x, run)
                overlap += int(np.count_nonzero(x[np.minimum(place, n - 1)] == run)) if n else 0
                passed = int(place[-1]) + int(place[-1] < n and x[place[-1]] == run[-1])
            else:
                passed = 0
            if overlap + min(n - passed, most - to) < rule.needed(n, least):
                continue
            found += [self.order[i] for i in ended if overlap >= rule.needed(n, to)]
            todo += [(c, overlap) for c in children]
        return found


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """class, size, elements for the classes in wanted (column class). A bitmap of fixed size keeps most others from being
    sent at all; the join decides."""
    bit = F.shiftrightunsigned("class", 8).bitwiseAND((1 << FILTER_BITS) - 1)
    marks = wanted.select(F.shiftright(bit, 15).alias("k"), bit.bitwiseAND(32767).alias("p"))
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for row in marks.groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect():  # 4096 bytes each
        bitmap[row["k"] * 4096 : (row["k"] + 1) * 4096] = row["m"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        flags = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            values, first = shingle_sets(batch.column("text"), rule.words)
            named = classes_of(values, first)
            bit = (named.astype(U64) >> U64(8)).astype(np.int64) & ((1 << FILTER_BITS) - 1)
            likely = (named != 0) & (flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1)
            own = []
            for i in np.flatnonzero(likely).tolist():
                if (c := int(named[i])) not in told:
                    told.add(c)
                    own.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(named[own]), pa.array([values[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())], names=["class", "elements"])

    sent = docs.mapInArrow(tidy(rows), "class long, elements binary")
    found = sent.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("elements").alias("elements"))
    return found.select("class", (F.octet_length("elements") / 8).cast("int").alias("size"), "elements")


def tried(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that link: of each a's partners a prefix tree is made, and probed with a. Pairs are dealt
    into units of about BLOCK by a and, for an a of more partners than that, by a hash of b; a unit has each a's set once."""
    many = max(1, pairs.count() // BLOCK)
    # An a may have a large share of all pairs: the few such are salted, so that no task gets all of one.
    heavy = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    heavy = heavy.select("a", F.ceil(F.col("n") / BLOCK).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(heavy.hint("merge"), ["a", "salt"], "left")
    slot = F.pmod(F.xxhash64("b", F.lit("slot")), F.coalesce("share", F.lit(1)))
    dealt = salted.select(F.pmod(F.xxhash64("a", slot), F.lit(many)).alias("unit"), "a", "b")
    rows = dealt.select("unit", "a", F.col("b").alias("class")).unionByName(dealt.select("unit", "a", F.col("a").alias("class")).distinct())

    def links(table: pa.Table) -> pa.Table:
        pivot, cls = table.column("a").to_numpy(), table.column("class").to_numpy()
        order = np.lexsort((cls != pivot, pivot))  # each pivot's own set comes first
        elements = table.column("elements")
        first = np.flatnonzero(np.concatenate([[True], pivot[order][1:] != pivot[order][:-1]]))
        keep: list[int] = []
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            x = np.frombuffer(elements[int(order[low])].as_py(), U64)
            others = order[low + 1 : high].tolist()
            keep += [others[i] for i in PrefixTree([np.frombuffer(elements[i].as_py(), U64) for i in others]).probe(x, rule)]
        released()
        return pa.table({"a": pa.array(pivot[keep]), "b": pa.array(cls[keep])})

    return rows.join(sets.select("class", "elements"), "class").groupBy("unit").applyInArrow(links, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of links (a, b). Alternating large and small stars; each
    round is grouped and joined by node, its result written to the shared folder."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = stored(edges, "join-edges")
    before = None
    while True:  # each round's edges replace those of the one before
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored(small.where("u != v").distinct(), "join-edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def units(members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of blocks that could hold links between different components of a group: a row for each class and pair,
    with the side it is on. members: class, family (the group), component, size."""
    open_ = members.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("family")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # A group or a component may hold a large share of all rows: they are salted, so that no task gets all of one.
    rows = members.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).withColumn("size_band", rule.size_band(F.col("size")))
    # Hints: what is salted has many times the rows that its input shows, so it isn't to be broadcast.
    rows = rows.join(open_.select("family", salt).hint("merge"), ["family", "salt"])
    count = rows.groupBy("family", "component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("family", "component", salt, F.col("component").alias("own"))
    rows = rows.join(count.hint("merge"), ["family", "component", "salt"], "left").withColumn("own", F.coalesce("own", F.lit(0)))  # no class is 0
    rows = stored(rows, "join-dealt")
    kinds = rows.groupBy("family", "own", "size_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    left = kinds.select("family", *(F.col(c).alias(f"{c}_i") for c in ("own", "size_band", "many")), F.explode(F.array("size_band", F.col("size_band") + 1)).alias("size_band_j"))
    right = kinds.select("family", *(F.col(c).alias(f"{c}_j") for c in ("own", "size_band", "many")))
    pairs = left.join(right, ["family", "size_band_j"]).where("own_i != own_j or own_i = 0").where("size_band_i < size_band_j or own_i <= own_j")
    pairs = pairs.withColumn("same", F.expr("size_band_i = size_band_j and own_i = own_j")).select("*", salt)

    def side(k: str, other: str) -> DataFrame:
        on = pairs.select(*(F.col(c) for c in pairs.columns)).withColumnsRenamed({f"own_{k}": "own", f"size_band_{k}": "size_band"})
        dealt = rows.join(on.hint("merge"), ["family", "own", "size_band", "salt"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col(f"many_{k}")).cast("int"))
        # A kind of blocks that meets itself: block k is left of itself and of those after it, right of those before.
        from_, to = (F.when(F.col("same"), F.col("block")).otherwise(0), F.col("many_j")) if k == "i" else (F.lit(0), F.when(F.col("same"), F.col("block")).otherwise(F.col("many_i")))
        blocks = F.filter(F.sequence(F.lit(0), F.col(f"many_{other}")), lambda b: (b >= from_) & (b < to))
        dealt = dealt.withColumn("with", F.explode(blocks)).withColumnsRenamed({"own": f"own_{k}", "size_band": f"size_band_{k}", "block": f"block_{k}", "with": f"block_{other}"})
        return dealt.select("family", "own_i", "size_band_i", "block_i", "own_j", "size_band_j", "block_j", "class", "component", F.lit(k == "i").alias("is_left"))

    return side("i", "j").unionByName(side("j", "i"))


def between(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between different components of each group that has several. members: class, family, component."""

    def links(table: pa.Table) -> pa.Table:
        cls, comp, is_left = (table.column(k).to_pylist() for k in ("class", "component", "is_left"))
        sets_ = [np.frombuffer(x, U64) for x in table.column("elements").to_pylist()]
        left = [k for k in range(len(cls)) if is_left[k]]
        one = table.column("block_i")[0] == table.column("block_j")[0] and table.column("own_i")[0] == table.column("own_j")[0] and table.column("size_band_i")[0] == table.column("size_band_j")[0]
        right = left if one else [k for k in range(len(cls)) if not is_left[k]]
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        tree = PrefixTree([sets_[k] for k in right])
        out = []
        for k in left:
            own = root(comp[k])
            for hit in tree.probe(sets_[k], rule, lambda i, own=own: root(comp[right[i]]) == own):
                if root(comp[right[hit]]) != root(comp[k]):
                    out.append((cls[k], cls[right[hit]]))
                    above[root(comp[right[hit]])] = root(comp[k])
        released()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    dealt = units(members.join(sets.select("class", "size"), "class"), rule)
    whole = dealt.join(sets.select("class", "elements"), "class")
    return whole.groupBy("family", "own_i", "size_band_i", "block_i", "own_j", "size_band_j", "block_j").applyInArrow(links, "a long, b long")


def joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """node, root: components of linked classes."""
    pairs = candidates(docs, rule)
    met = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    sets = stored(sets_of(docs, met, rule), "join-sets")
    links = stored(tried(pairs, sets, rule), "join-links")
    component = connected(links)
    members = pairs.select(F.col("a").alias("family"), F.col("b").alias("node"))
    members = members.join(component.withColumnRenamed("root", "c"), "node", "left")
    members = members.select(F.col("node").alias("class"), "family", F.coalesce("c", "node").alias("component"))
    members = stored(members, "join-members")
    discard(pairs)
    more = stored(between(members, sets, rule), "join-links")
    discard(members, sets)
    if more.isEmpty():
        return component
    return connected(links.unionByName(more))


def components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(sized(docs, rule), "join-sizes")
    roots = joined(docs, rule)
    named = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, named["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    named = stored(named, "join-classes")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(lowest, "root").select("class", "component_id")
    out = rows.join(by_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def kept(docs: DataFrame, rule: Rule) -> DataFrame:
    """Of each component one row, that of the smallest doc_id (null last; then of the least class), and every row with
    an empty set; docs' own columns."""
    mark, doc, lead_ = (own_name(docs, k) for k in ("_class", "_doc", "_lead"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            named = classes_of(*shingle_sets(batch.column("text"), rule.words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named)], names=[*batch.schema.names, mark])

    own = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(sized(own, rule), "join-sizes").where("n_shingles > 0")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("lead")
    by_class = rows.groupBy("class").agg(place)
    roots = joined(own, rule)
    lead = by_class.join(roots, by_class["class"] == roots["node"], "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("lead").alias("lead"))
    lead = lead.select(F.col("lead.doc_id").alias(doc), F.col("lead.class").alias(lead_))
    marked = docs.mapInArrow(tidy(classed), StructType([*docs.schema.fields]).add(mark, LongType()))
    whole = marked.where(F.col(mark) != 0).join(lead, (F.col(mark) == F.col(lead_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
    first = whole.dropDuplicates(["doc_id", mark])
    return first.unionByName(marked.where(F.col(mark) == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
