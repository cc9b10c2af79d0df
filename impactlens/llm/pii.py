"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside fixed base patterns.

The base patterns find emails, IP addresses, card numbers and phone numbers; the model adds spans that they miss: phone
numbers without a plus sign, cards of 13 to 15 digits or with dots, addresses written with [at] and [dot] or [.], IPv6.
It is trained in numpy, on labelled spans that a seeded generator sets into lines of made-up words with decoys (dates,
versions, keys, prices, numbers in groups of three). Texts are read in overlapping windows; each is decoded by Viterbi,
and the windows' spans are reconciled over the whole text: the non-overlapping set of greatest total score wins. The
model decides; what it adds must only be possible for its kind (checksum, number of digits, characters).

Semantics
- Base spans always stay; added ones overlap no base span. Offsets are code points, ends exclusive.
- Every span of these kinds holds a digit, @ or a bracketed `at`, so windows without any are decoded as empty without
  being computed. Behind a text's end, windows are filled with a symbol that training shows there, too.
- Null and empty texts have no spans. Repeated rows agree; an empty table gives an empty result; extra columns are
  ignored. Each text is scanned as a whole, in time proportional to its length. A span of more than WINDOW - STRIDE
  characters may be missed by the model.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from impactlens.llm.common import slices, tidy, utf8

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 80, 32
HIDDEN, EMBEDDING = 16, 12
SYMBOLS = 130  # ASCII, other letters, the rest
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside for each kind

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end of the base patterns' matches, by kind and place."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at)
        if found:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, found.end()))
                last = found.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


AT, DOT = re.compile(r"\s*[\[({]\s?at\s?[\])}]\s*", re.I), re.compile(r"\s*[\[({]\s?(?:dot|\.)\s?[\])}]\s*", re.I)


def checked(kind: str, text: str) -> bool:
    """Whether what the model marks can be of its kind at all."""
    d = digits(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 2 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", text) is not None
    if kind == "phone":
        return 8 <= len(d) <= 15 and d != text and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text) is not None
    if kind == "ip":
        plain = DOT.sub(".", text)
        if ":" not in plain:
            return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", plain) is not None and all(int(x) < 256 for x in plain.split("."))
        try:
            return bool(ipaddress.IPv6Address(plain))
        except ValueError:
            return False
    return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", DOT.sub(".", AT.sub("@", text))) is not None


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, points, np.where(points > 0x024F, 129, 128)).astype(np.int64)


# Labelled spans for training.


PHONES = ["(9##) ###-####", "9##-###-####", "9##.###.####", "9## ### ####", "0## #### ####", "0# ## ## ## ##", "(9##)###-####", "1-9##-###-####", "+1 9##-###-####", "+1 (9##) ###-####", "+44 20 #### ####", "0###/#######", "0### ######", "+49 ### #######"]
LEAD = {"phone": ["tel", "call", "phone", "Tel.:", "fax:", "ring", "mobile"], "email": ["mail", "write to", "contact:"], "ip": ["host", "from", "server"], "card": ["card", "visa", "paid with"]}
DECOYS = [
    "####-##-##", "##/##/####", "##.##.####", "##:##", "##:##:##", "#.#", "v#.##.#", "#.#.#", "$###.##", "## ###", "# ### ###", "### ### ###", "####-####", "#####|####", "##%", "#", "##", "####", "######", "##########", "###-##-####",
    "978-#-##-######-#", "@~", "~@~", "(at) ##", "~ [#]", "[##]", "AKIA####JLEK###", "password=####ef###", "4.0.", "no. ####/##", "x-##-###", "###-####",
]


def _line(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A window of text and its spans: words, decoys and labelled spans. Some end before the window does."""
    letters = list("etaoinshrdlucmfwypvbgkqjxzéèñüß")
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    word = lambda: "".join(rng.choice(letters, int(rng.integers(1, 10))))
    plain = lambda: word().encode("ascii", "ignore").decode() or "a"
    digit = {"#": "0123456789", "9": "23456789"}

    def shaped(shape: str, marks: str = "#") -> str:
        return "".join(pick(digit[c]) if c in marks else word() if c == "~" else c for c in shape)

    def card() -> str:
        n, sep = int(pick([13, 14, 15, 16, 16, 19])), pick(["", " ", "-", "."])
        d = pick("3456") + shaped("#" * (n - 2))
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = [4, 10] if n in (14, 15) and rng.random() < 0.7 else range(4, n, 4)
        return sep.join(d[i:j] for i, j in zip([0, *cuts], [*cuts, n], strict=True))

    def email() -> str:
        user = pick([plain(), f"{plain()}.{plain()}", f"{plain()}{shaped('##')}", f"{plain()}_{plain()}", f"{plain()}.{shaped('##')}"])
        host, end = pick([f"mail{shaped('#')}.example", plain(), f"{plain()}-{plain()}"]), pick(["com", "org", "net", "co.uk", "de", "fr"])
        at, dot = pick([("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("[at]", ".")])
        return f"{user}{at}{host}{dot}{end}"

    def ip() -> str:
        if rng.random() < 0.25:
            groups = [f"{int(x):x}" for x in rng.integers(1, 65536, 8)]
            return ":".join(groups) if rng.random() < 0.4 else ":".join(groups[: int(rng.integers(1, 4))]) + "::" + ":".join(groups[: int(rng.integers(1, 4))])
        return pick([".", ".", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4))

    text, spans = "", []
    while len(text) < 2 * WINDOW:
        roll = rng.random()
        if roll < 0.24:
            kind = pick(KINDS)
            if rng.random() < 0.3:
                text += pick(LEAD[kind]) + " "
            s = {"email": email, "ip": ip, "card": card, "phone": lambda: shaped(pick(PHONES), "#9")}[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        elif roll < 0.45:
            text += shaped(pick(DECOYS)) if rng.random() < 0.9 else "".join(rng.choice(list("0123456789abcdef"), int(rng.integers(16, 41))))
        else:
            text += word() if rng.random() < 0.9 else word().upper()
        text += pick([" ", " ", " ", ", ", ". ", ".\n", " (", ") ", ": ", "; "])
    at = int(rng.integers(0, WINDOW))
    if rng.random() < 0.4:  # the text's beginning, or its end
        at = 0 if rng.random() < 0.4 else at
        stop = min(len(text), at + int(rng.integers(3, WINDOW)))
        stop = next((b for _, a, b in spans if a < stop < b and b <= at + WINDOW), stop)
    else:
        stop = at + WINDOW
    return text[at:stop], [(k, max(0, a - at), min(stop, b) - at) for k, a, b in spans if b > at and a < stop]


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of n windows; 0 stands behind the text's end."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = _line(rng)
        x[i, : len(text)] = symbols(text)
        for kind, a, b in spans:
            y[i, a:b] = 2 + 2 * KINDS.index(kind)
            y[i, a] -= 1
    return x, y


# The network. Time runs along the first axis.


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(inputs: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Both directions at once. inputs: the gates' input part, time x direction x batch x 4H; u: direction x H x 4H.
    Returns hidden states and, if asked for, what the backward pass needs."""
    steps, both, batch, _ = inputs.shape
    h, c = np.zeros((both, batch, HIDDEN), np.float32), np.zeros((both, batch, HIDDEN), np.float32)
    out, kept = np.zeros((steps, both, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ u
        s = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((i, f, o, g, before, tc, last))
    return out, kept


def _lstm_back(d_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, both, batch, _ = d_out.shape
    dz_all, du = np.zeros((steps, both, batch, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((both, batch, HIDDEN), np.float32), np.zeros((both, batch, HIDDEN), np.float32)
    back = u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, last = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
        dz_all[t] = dz
        du += last.transpose(0, 2, 1) @ dz
        dh, dc = dz @ back, dc * f
    return dz_all, du


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _crf_gradient(scores: np.ndarray, moves: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, and its gradients by emission scores (time x batch x tags) and transitions."""
    steps, batch, _ = scores.shape
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    a[0] = scores[0]
    for t in range(1, steps):
        a[t] = scores[t] + _log_sum(a[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _log_sum(moves + (scores[t + 1] + b[t + 1])[:, None, :], 2)
    z = _log_sum(a[-1], 1)
    d_scores = np.exp(a + b - z[None, :, None])
    d_moves = np.zeros_like(moves)
    rows = np.arange(batch)
    path = np.zeros(batch)
    for t in range(steps):
        if t:
            d_moves += np.exp(a[t - 1][:, :, None] + moves + (scores[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(d_moves, (y[:, t - 1], y[:, t]), -1)
            path += moves[y[:, t - 1], y[:, t]]
        path += scores[t, rows, y[:, t]]
        d_scores[t, rows, y[:, t]] -= 1
    return float((z - path).mean()), d_scores / batch, d_moves / batch


class Tagger:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"e": init(SYMBOLS, EMBEDDING), "out": init(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "moves": init(TAGS, TAGS)}
        for d in "lr":
            self.p |= {f"w{d}": init(EMBEDDING, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores by time, window and tag. x: windows x time. The input part of the gates is one lookup per symbol."""
        p = self.p
        flow = x.T
        inputs = np.stack([(p["e"] @ p["wl"] + p["bl"])[flow], (p["e"] @ p["wr"] + p["br"])[flow[::-1]]], 1)
        hidden, kept = _lstm(inputs, np.stack([p["ul"], p["ur"]]), keep)
        both = np.concatenate([hidden[:, 0], hidden[::-1, 1]], 2)
        scores = both @ p["out"] + p["bias"]
        return (scores, both, kept) if keep else scores

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, flow = self.p, x.T
        scores, both, kept = self.emissions(x, keep=True)
        loss, d_scores, d_moves = _crf_gradient(scores.astype(np.float64), p["moves"].astype(np.float64), y)
        d_scores = d_scores.astype(np.float32)
        wide = both.reshape(-1, both.shape[2])
        g = {"moves": d_moves, "bias": d_scores.sum((0, 1)), "out": wide.T @ d_scores.reshape(len(wide), -1), "e": np.zeros_like(p["e"])}
        d_both = d_scores @ p["out"].T
        dz, du = _lstm_back(np.stack([d_both[:, :, :HIDDEN], d_both[::-1, :, HIDDEN:]], 1), kept, np.stack([p["ul"], p["ur"]]))
        for k, (d, order) in enumerate((("l", flow), ("r", flow[::-1]))):
            # Which symbol stood where, as a sparse sum: sorted runs.
            sort = np.argsort(order.ravel(), kind="stable")
            seen, first = np.unique(order.ravel()[sort], return_index=True)
            by = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
            by[seen] = np.add.reduceat(dz[:, k].reshape(-1, 4 * HIDDEN)[sort], first, axis=0)
            g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = du[k], p["e"].T @ by, by.sum(0)
            g["e"] += by @ p[f"w{d}"].T
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02) -> None:
        """Adam."""
        rng = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        n = 0
        total = epochs * (len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x) - batch + 1, batch):
                own = order[at : at + batch]
                _, g = self.step(x[own], y[own])
                n += 1
                now = rate * (1 - 0.9 * n / total)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (Viterbi), and how much each place, with the move to it, adds to the score of being
        outside all along."""
        scores, moves = self.emissions(x), self.p["moves"]
        steps, batch, _ = scores.shape
        back = np.zeros((steps, batch, TAGS), np.int8)
        best = scores[0]
        for t in range(1, steps):
            way = best[:, :, None] + moves
            back[t] = way.argmax(1)
            best = way.max(1) + scores[t]
        tags = np.zeros((batch, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        flow = np.arange(steps)
        by_window = scores.transpose(1, 0, 2)
        more = by_window[rows[:, None], flow, tags] - by_window[:, :, 0]
        more[:, 1:] += moves[tags[:, :-1], tags[:, 1:]] - moves[0, 0]
        return tags, more


@lru_cache(maxsize=1)
def trained(windows: int = 5000, epochs: int = 7) -> Tagger:
    """The production model; the same each time."""
    tagger = Tagger()
    tagger.train(*labelled(windows, 11), epochs)
    return tagger


MARKED = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.I)


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The model's spans in each text, windows reconciled over the whole text."""
    rows, starts, parts = [], [], []
    for i, text in enumerate(texts):
        marked = [m.start() for m in MARKED.finditer(text)]
        own = {w for p in marked for w in range(max(0, (p - WINDOW) // STRIDE + 1), p // STRIDE + 1) if w * STRIDE < len(text)}
        coded = np.concatenate([symbols(text), np.zeros(WINDOW, np.int64)]) if own else None
        for w in sorted(own):
            rows.append(i)
            starts.append(w * STRIDE)
            parts.append(coded[w * STRIDE : w * STRIDE + WINDOW])
    found: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    for at in range(0, len(parts), 1024):
        tags, margin = tagger.decode(np.array(parts[at : at + 1024]))
        for k in np.flatnonzero(tags.any(1)).tolist():
            i, start = rows[at + k], starts[at + k]
            row, t = tags[k].tolist(), 0
            while t < WINDOW:
                if row[t] == 0:
                    t += 1
                    continue
                kind = (row[t] - 1) // 2
                to = t + 1
                while to < WINDOW and row[to] == 2 + 2 * kind:
                    to += 1
                # A span that touches an inner edge of the window is left to the neighbour that sees all of it.
                if start + t < len(texts[i]) and (t > 0 or start == 0) and (to < WINDOW or start + WINDOW >= len(texts[i])):
                    stop = to + (to < WINDOW and row[to] == 0)  # with the move out of the span
                    found[i].append((float(margin[k, t:stop].sum()), start + t, min(start + to, len(texts[i])), KINDS[kind]))
                t = to
    return [reconciled(f) for f in found]


def reconciled(spans: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int]]:
    """The non-overlapping spans of greatest total score."""
    spans = sorted({(b, a, k): s for s, a, b, k in sorted(spans)}.items())
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # score, index of the last span, best before it
    ends = [0]
    for n, ((b, a, _), s) in enumerate(spans):
        j = int(np.searchsorted(ends, a, "right")) - 1
        with_it = best[j][0] + s
        best.append((with_it, n, j) if with_it > best[-1][0] else (best[-1][0], -2, len(best) - 1))
        ends.append(b)
    out, at = [], len(best) - 1
    while at > 0:
        _, n, before = best[at]
        if n >= 0:
            (b, a, k), _ = spans[n]
            out.append((k, a, b))
        at = before
    return out[::-1]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and not (text[start].isalnum() or text[start] in "(+"):
        start += 1
    return start, end


def all_spans(text: str, base: list[tuple[str, int, int]], proposed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those proposed (which overlap none of each other) that are possible and overlap no base span."""
    out = list(base)
    ordered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in ordered], []
    for _, b in ordered:
        reach.append(max(b, reach[-1] if reach else 0))
    for kind, a, b in proposed:
        a, b = trimmed(text, a, b)
        alone = a < b and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        before = bisect_left(starts, b)
        # Digits of a longer number are no phone or card of their own.
        if alone and checked(kind, text[a:b]) and not (before and reach[before - 1] > a) and text[max(0, a - 1) : a] not in ("+", "-", ".") and text[b : b + 1] != "-":
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Counts of the base spans, a digest of them, all spans and how many they are, for each row."""
    tagger = tagger or trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(256, bool)
        marks[[*b"0123456789@[({"]] = True
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            own = np.unique(np.searchsorted(offsets, np.flatnonzero(marks[data]), "right") - 1).tolist()
            texts = [batch.column("text")[i].as_py() for i in own]
            counts, digest, spans = np.zeros((len(KINDS), batch.num_rows), np.int64), [nothing] * batch.num_rows, [""] * batch.num_rows
            many = np.zeros(batch.num_rows, np.int64)
            for i, text, proposed in zip(own, texts, model_spans(tagger, texts), strict=True):
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[KINDS.index(kind), i] += 1
                digest[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                both = all_spans(text, base, proposed)
                spans[i], many[i] = listed(both), len(both)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(many)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(rows), FOUND)


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
