"""Chat formatting: raw transcripts are parsed into turns by a hidden Markov model and rendered canonically.

A line's observation is its speaker marker (the first word of the line, if a marker's punctuation follows or encloses
it), its shape, its length and how the line before it ended. States are role x (turn begins | goes on). Start, move and
emission probabilities are smoothed counts from labelled transcripts; Viterbi recovers the states, all transcripts of a
batch step by step together; markers are cut off, lines of a turn joined, and turns rendered as `<|role|>\\ntext\\n`.

A conversation stands in segments of `SEGMENT` turn numbers, so that none is gathered in one task, and is decoded as a
whole all the same: of each segment, the best scores from any state before it to any state at its end make a matrix; these
are multiplied (greatest sum instead of sum of products) along the conversation, `SEGMENT` of them at a time, level upon
level; that gives the best path's state at each cut, and each segment is then decoded between the states at its ends.

Semantics
- A row without conv_id or turn is a transcript of its own. Rows of one turn stand in order of role and text; repeated
  rows are turns of their own.
- Null text is an empty line; a null role is a role of its own, `unknown`. An empty transcript has no turns. An empty
  table gives an empty result; extra columns are ignored.
- `continues` says that a segment's first lines belong to the last turn of the segment before it.
- The model learns from about `LEARNED` segments, picked by hash among those that are not held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactlens.llm.common import stored

SEGMENT, LEARNED = 256, 600
#: How transcripts mark a speaker's turn, by style; the role's word is put in.
STYLES = ["{}: ", "### {}:\n", "[{}] ", "<|{}|>\n", "**{}**: ", "{} > "]
#: Words for the roles, by style.
NAMES = {
    "user": ["User", "Human", "user", "user", "Customer", "me"],
    "assistant": ["Assistant", "Assistant", "assistant", "assistant", "Agent", "bot"],
    "system": ["System", "Instruction", "system", "system", "Note", "setup"],
}
MARKER = re.compile(r"^\s*(?:<\|(\w+)\|>|\[(\w+)\]|\*\*(\w+)\*\*:|#+\s*(\w+):|(\w+)(?::|\s>))\s?")


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, alone, held_out, roles, texts, transcript: raw transcripts in one of the styles, with their truth.
    alone tells apart the rows that are transcripts of their own."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("alone", alone).withColumn("segment", F.floor(F.coalesce("turn", F.lit(0)) / SEGMENT))
    style = F.pmod(F.crc32(F.concat(F.lit("style"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).cast("binary")), F.lit(len(STYLES)))
    marker = F.concat(F.lit(""))
    for k, shape in enumerate(STYLES):
        head, _, tail = shape.partition("{}")
        word = F.col("role")
        for role, names in NAMES.items():
            word = F.when(F.col("role") == role, names[k]).otherwise(word)
        marker = F.when(style == k, F.concat(F.lit(head), word, F.lit(tail))).otherwise(marker)
    rows = rows.withColumn("line", F.concat(marker, "text"))
    grouped = rows.groupBy("conv_id", "segment", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("turns"))
    return grouped.select("conv_id", "segment", "alone", held_out(F.col("conv_id")).alias("held_out"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"), F.array_join("turns.line", "\n").alias("transcript"))


def end_of(line: str) -> str:
    bare = line.strip()
    return "blank" if not bare else bare[-1] if bare[-1] in ".?!:>]" else "letter"


def observed(lines: list[str], end: str = "start") -> list[tuple]:
    """Features of each line: marker word, shape, length class, end of the line before."""
    out = []
    for line in lines:
        m = MARKER.match(line)
        word = next((g for g in m.groups() if g), "").lower() if m else "-"
        bare = line.strip()
        shape = "blank" if not bare else "marker-only" if m and m.end() >= len(line.rstrip()) else "capital" if bare[0].isupper() else "other"
        out.append((word, shape, min(8, len(bare).bit_length()), end))
        end = end_of(line)
    return out


def labelled_lines(roles: list[str], texts: list[str], transcript: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """The transcript's lines and the state of each: its role, and whether a turn begins there."""
    lines, states, at = transcript.split("\n"), [], 0
    for role, text in zip(roles, texts, strict=True):
        many = text.count("\n") + 1
        while at + many < len(lines) and not _same(lines[at : at + many], text.split("\n")):
            many += 1
            if many > text.count("\n") + 2:
                break
        states += [(role, True)] + [(role, False)] * (many - 1)
        at += many
    return lines, (states + [(roles[-1], False)] * len(lines))[: len(lines)] if roles else []


def _same(lines: list[str], text: list[str]) -> bool:
    return lines[0].endswith(text[0]) and lines[1:] == text[1:]


class Model:
    """Smoothed counts of a first-order hidden Markov model with several independent observations a line."""

    def __init__(self, samples: list[tuple[list[str], list[tuple[str, bool]]]]):
        start, move, emit, seen = Counter(), Counter(), defaultdict(Counter), Counter()
        for lines, states in samples:
            for k, (features, state) in enumerate(zip(observed(lines), states, strict=True)):
                seen[state] += 1
                start[state] += k == 0
                if k:
                    move[states[k - 1], state] += 1
                for f, value in enumerate(features):
                    emit[state][f, value] += 1
        self.states = sorted(seen) or [("unknown", True)]
        n = len(self.states)
        log = lambda x, total, kinds: np.log((x + 0.1) / (total + 0.1 * kinds))
        self.start = np.array([log(start[s] if s[1] else 0, sum(start.values()), n) if s[1] else -30 for s in self.states])
        out = Counter(a for a, _ in move.elements())
        # A turn goes on only in its own role.
        self.move = np.array([[log(move[a, b], out[a], n) if b[1] or a[0] == b[0] else -30 for b in self.states] for a in self.states])
        values = {v for s in emit.values() for v in s}
        kinds = Counter(f for f, _ in values)
        self.emit = {v: np.array([log(emit[s][v], seen[s], kinds[v[0]] + 1) for s in self.states]) for v in values}
        self.new = [np.array([log(0, seen[s], kinds[f] + 1) for s in self.states]) for f in range(4)]

    def scores(self, features: list[tuple]) -> np.ndarray:
        """Emission scores by line and state."""
        return np.array([sum(self.emit.get((f, v), self.new[f]) for f, v in enumerate(x)) for x in features]).reshape(len(features), len(self.states))

    def paths(self, scores: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The best state of every line (Viterbi). Transcripts stand one after the other, from `first`; begin: scores of the
        states at each one's first line; end: the state that its last line must have, -1 for any."""
        lengths = np.diff(first)
        best = begin.copy()
        back = np.zeros(scores.shape, np.int32)
        lanes = np.flatnonzero(lengths > 0)
        best[lanes] += scores[first[lanes]]
        step = 1
        while len(lanes := lanes[lengths[lanes] > step]):
            way = best[lanes][:, :, None] + self.move
            at = first[lanes] + step
            back[at] = way.argmax(1)
            best[lanes] = way.max(1) + scores[at]
            step += 1
        state = np.where(end >= 0, end, best.argmax(1))
        out = np.zeros(len(scores), np.int64)
        for step in range(int(lengths.max(initial=0))):  # from each one's last line
            lanes = np.flatnonzero(lengths > step)
            at = first[lanes + 1] - 1 - step
            out[at] = state[lanes]
            state[lanes] = back[at, state[lanes]]
        return out

    def matrix(self, scores: np.ndarray) -> np.ndarray:
        """The best scores from any state before these lines to any state of the last of them."""
        best = self.move + scores[0]
        for s in scores[1:]:
            best = times(best, self.move) + s
        return best

    def decode(self, lines: list[str]) -> list[tuple[str, bool]]:
        first = np.array([0, len(lines)])
        return [self.states[i] for i in self.paths(self.scores(observed(lines)), first, self.start[None, :].copy(), np.array([-1]))]

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        lines = transcript.split("\n") if transcript else []
        return turns_of(lines, self.decode(lines))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of matrices in which the greatest sum stands for the sum of products."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def turns_of(lines: list[str], states: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    out: list[tuple[str, list[str]]] = []
    for line, (role, begins) in zip(lines, states, strict=True):
        if begins or not out:
            mark = MARKER.match(line) if begins else None
            cut = line[mark.end() :] if mark else line
            out.append((role, [] if mark and not cut else [cut]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text)) for role, text in out]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n" for role, text in turns)


def fit(labelled: DataFrame, learned: int = LEARNED) -> Model:
    """labelled: what `transcripts` gives. Counted first, then about `learned` of them are picked by hash."""
    own = labelled.where(~F.col("held_out"))
    n = max(1, own.count())
    pick = F.pmod(F.xxhash64("conv_id", "segment"), F.lit(1 << 20)) / float(1 << 20)
    rows = own.where(pick < learned / n).select("roles", "texts", "transcript").collect()
    return Model([labelled_lines(r["roles"], r["texts"], r["transcript"]) for r in sorted(rows, key=lambda r: r["transcript"])])


def cuts(matrices: DataFrame, model: Model, each: int = SEGMENT) -> DataFrame:
    """conv_id, segment, entry, leave: the states before and at the end of every segment on the best path of its
    conversation. matrices: conv_id, segment (0, 1, ... in order), m (bytes; the first one's rows are all its best scores
    from the start). Of a conversation, no more than `each` matrices come together in a task."""
    n = len(model.states)

    def solved(frame: pd.DataFrame, entry: int | None = None, leave: int | None = None) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        ms = [np.frombuffer(x).reshape(n, n) for x in frame["m"]]
        forward = [ms[0][entry if entry is not None else 0]]
        for m in ms[1:]:
            forward.append((forward[-1][:, None] + m).max(0))
        ends = [int(forward[-1].argmax()) if leave is None else leave]
        for k in range(len(ms) - 1, 0, -1):
            ends.append(int((forward[k - 1] + ms[k][:, ends[-1]]).argmax()))
        ends = ends[::-1]
        begins = [entry if entry is not None else -1, *ends[:-1]]
        return pd.DataFrame({"conv_id": frame["conv_id"], "segment": frame["segment"], "entry": begins, "leave": ends})

    result = "conv_id long, segment long, entry long, leave long"
    if (matrices.agg(F.max("segment")).first()[0] or 0) < each:
        return matrices.groupBy("conv_id").applyInPandas(lambda f: solved(f), result)
    grouped = matrices.withColumn("block", F.floor(F.col("segment") / each))

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        whole = np.frombuffer(frame["m"].iloc[0]).reshape(n, n)
        for x in frame["m"].iloc[1:]:
            whole = times(whole, np.frombuffer(x).reshape(n, n))
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1], "segment": frame["block"].iloc[:1], "m": [whole.tobytes()]})

    above = cuts(stored(grouped.groupBy("conv_id", "block").applyInPandas(product, "conv_id long, segment long, m binary"), "chat-blocks"), model, each)
    inside = grouped.join(above.select("conv_id", F.col("segment").alias("block"), "entry", "leave"), ["conv_id", "block"])

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        entry = int(frame["entry"].iloc[0])
        return solved(frame, None if entry < 0 else entry, int(frame["leave"].iloc[0]))

    return inside.groupBy("conv_id", "block").applyInPandas(within, result)


PARSED = "conv_id long, segment long, held_out boolean, n_lines long, n_turns long, n_right long, continues boolean, turns array<struct<role:string,text:string>>, rendered string"


def parse(raw: DataFrame, model: Model, each: int = SEGMENT) -> DataFrame:
    """Turns and canonical text of each segment; n_right: turns recovered exactly, where roles and texts are known."""
    order = Window.partitionBy("conv_id").orderBy("segment")
    several = raw.where("alone is null").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    long = raw.where("alone is null").join(several, "conv_id", "left_semi").select("conv_id", "segment", F.substring_index("transcript", "\n", -1).alias("last"))
    # A row for each segment of the long ones: its number, and the last line before it.
    placed = long.select("conv_id", "segment", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lag("last").over(order).alias("before"))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for place, before, transcript in zip(batch["place"], batch["before"], batch["transcript"], strict=True):
                scores = model.scores(observed(transcript.split("\n"), "start" if place == 0 else end_of(before)))
                m = model.matrix(scores)
                if place == 0:  # every row: from the start
                    best = model.start + scores[0]
                    for s in scores[1:]:
                        best = (best[:, None] + model.move).max(0) + s
                    m = np.repeat(best[None, :], len(best), 0)
                found.append(m.tobytes())
            yield pd.DataFrame({"conv_id": batch["conv_id"], "segment": batch["place"], "m": found})

    own = raw.where("alone is null").select("conv_id", "segment", "transcript").join(placed, ["conv_id", "segment"])
    known = cuts(stored(own.select("conv_id", "place", "before", "transcript").mapInPandas(measured, "conv_id long, segment long, m binary"), "chat-matrices"), model, each)
    ends = placed.join(known.withColumnRenamed("segment", "place"), ["conv_id", "place"]).select("conv_id", "segment", "before", "entry", "leave")
    ends = ends.withColumnsRenamed({"conv_id": "of", "segment": "at"})
    rows_ = raw.join(ends, F.col("alone").isNull() & (F.col("conv_id") == F.col("of")) & (F.col("segment") == F.col("at")), "left")
    rows_ = rows_.select("conv_id", "segment", "held_out", "roles", "texts", "transcript", "before", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("leave", F.lit(-1)).alias("leave"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [t.split("\n") if t else [] for t in batch["transcript"]]
            entry, leave = batch["entry"].to_numpy(), batch["leave"].to_numpy()
            features = [x for own, e, b in zip(lines, entry, batch["before"], strict=True) for x in observed(own, "start" if e < 0 else end_of(b or ""))]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
            begin = np.where(entry[:, None] >= 0, model.move[np.maximum(entry, 0)], model.start)
            path = model.paths(model.scores(features), first, begin, leave)
            out = []
            for k, r in enumerate(batch.itertuples(index=False)):
                states = [model.states[i] for i in path[first[k] : first[k + 1]]]
                turns = turns_of(lines[k], states)
                truth = Counter(zip(r.roles, r.texts, strict=True))
                out.append((r.conv_id, r.segment, r.held_out, r.transcript.count("\n") + 1, len(turns), sum((Counter(turns) & truth).values()), bool(r.entry >= 0 and states and not states[0][1]), [{"role": a, "text": b} for a, b in turns], render(turns)))
            frame = pd.DataFrame(out, columns=["conv_id", "segment", "held_out", "n_lines", "n_turns", "n_right", "continues", "turns", "rendered"])
            yield frame.astype({"conv_id": "Int64", "segment": "Int64"})

    return rows_.mapInPandas(rows, PARSED)


def query(spark, sf_dir: str) -> DataFrame:
    raw = stored(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "chat")
    found = parse(raw, fit(raw))
    return found.select("conv_id", "segment", "held_out", "n_lines", "n_turns", "n_right", "continues", F.array_join("turns.role", ",").alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256"))
