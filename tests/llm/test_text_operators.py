"""Each operator against a plain version in Python, on the smallest tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import by_row, plain_judged, plain_phrases
from pyspark.sql import functions as F

from impactlens.llm import decontam, langid, lm, media, mixing, ngram_join, pii, tokens

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=["docs", "odd", "nothing"])
def table(request):
    return request.getfixturevalue(request.param)


def test_word_count(table):
    found = table.select("text", mixing.words_in(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(BLANKS.findall(r["text"] or "")) for r in found)


def test_mixing_targets(table):
    sizes = Counter()
    rows = table.select("source", "text").collect()
    for r in rows:
        sizes[r["source"]] += len(BLANKS.findall(r["text"] or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] / open_ > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / open_ for s in sizes}
    planned = mixing.plan(table).collect()
    assert len(planned) == len(rows)
    for r in planned:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate), math.ceil(rate))
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert mixed.count() == sum(r["copies"] for r in planned)


def test_mixing_comes_near(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 7}") for i in range(7000)]
    planned = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in planned.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.08
    assert by_row(planned, "doc_id", "taken") == by_row(mixing.plan(planned.select("doc_id", "text", "source")), "doc_id", "taken")


def test_mixing_keeps_odd_columns(spark):
    """A column named as one of the plan's own stays, and rows without an id draw by their text."""
    rows = [(None, f"w {i} " + "x " * (i % 9), "s", i) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _source long")
    planned = mixing.plan(table.unionByName(spark.createDataFrame([(5, "one " * 9000, "t", -1)], table.schema)))
    assert "_source" in planned.columns and {r["_source"] for r in planned.select("_source").collect()} == {-1, *range(2000)}
    assert len({r["copies"] for r in planned.where("source = 's'").select("copies").collect()}) == 2


def shingles(text, words):
    found = BLANKS.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def plain_components(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
                above[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(sets[i]), least.get(root(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 80, 100), ngram_join.Rule(1, 60, 100)])
def test_components(table, rule):
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert by_row(ngram_join.components(table, rule), "doc_id", "n_shingles", "component_id") == plain_components(rows, rule)


def families(seed):
    rng = np.random.default_rng(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(30))
    for family in range(12):
        size = int(rng.integers(5, 120))
        words = [f"w{rng.integers(0, 400)}" for _ in range(size)]
        for _ in range(int(rng.integers(1, 25))):
            own = list(words)
            for _ in range(int(rng.integers(0, 1 + size // 12))):
                own[int(rng.integers(0, size))] = f"x{rng.integers(0, 10_000)}"
            rows.append((len(rows), " ".join(own) + (f" {passage}" if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(2, 80, 100)])
@pytest.mark.parametrize("crowd", [64, 3])
def test_components_of_families(spark, rule, crowd, monkeypatch):
    """Chains of near copies and a shared passage; with a low limit for crowded parts, most parts are crowded."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = families(crowd)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    source = ngram_join.meetings
    if crowd == 3:
        import inspect

        namespace = dict(vars(ngram_join), CROWD=3)
        exec(inspect.getsource(source), namespace)  # the limit travels to the workers with the function
        monkeypatch.setattr(ngram_join, "meetings", namespace["meetings"])
    assert by_row(ngram_join.components(table, rule), "doc_id", "n_shingles", "component_id") == plain_components(rows, rule)


def test_prefix_tree():
    rng = np.random.default_rng(3)
    rule = ngram_join.Rule(1, 70, 100)
    sets = [np.unique(rng.integers(1, 14, rng.integers(0, 12))).astype(np.uint64) for _ in range(200)]
    tree = ngram_join.PrefixTree([s for s in sets if len(s)])
    whole = [set(s.tolist()) for s in sets if len(s)]
    for x in sets[:60]:
        want = [i for i, s in enumerate(whole) if len(x) and 100 * len(s & set(x.tolist())) >= 70 * len(s | set(x.tolist()))]
        assert sorted(tree.probe(x, rule)) == want if len(x) else True


def test_one_stays(table):
    rule = ngram_join.Rule(5, 80, 100)
    kept = ngram_join.kept(table, rule)
    assert kept.columns == table.columns
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    sets = [shingles(t, 5) for _, t in rows]
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    left = [shingles(r["text"], 5) for r in kept.collect()]
    full = [s for s in left if s]
    assert sum(not s for s in left) == sum(not s for s in sets)
    assert not any(linked(a, b) for i, a in enumerate(full) for b in full[:i])
    groups = {(d, c) for d, n, c in plain_components(rows, rule) if n}
    assert len(full) >= len({c for _, c in groups if c is not None})


@pytest.mark.parametrize("block", [10**6, 50])
def test_decontamination(spark, docs, odd, nothing, sf_dir, block):
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    odd_texts = [r["text"] for r in odd.limit(30).collect()]
    again = [(bench[0][0], " ".join(odd_texts[6].split()[20:60])), (900, "ONE"), (900, "kappa"), (None, "beta"), (bench[0][0], bench[0][1])]
    extra = [*again, (900, "one"), (901, ""), (902, None), (903, "two words"), (904, (odd_texts[6] or "")[30:400]), (905, "alpha alpha ALPHA"), (906, "alpha " * 15), (None, "delta1")]
    items = spark.createDataFrame([*bench, *extra], "item_id long, text string")
    for table in (docs, odd, nothing):
        rows = table.select("doc_id", "text").collect()
        want = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, *plain_judged(r["text"], [*bench, *extra], 10)) for r in rows])
        got = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.judge(table, items, block_words=block).collect()])
        assert got == want
        clean = decontam.clean(table, items, block_words=block)
        assert clean.columns == table.columns and clean.count() == sum(w[3] == 0 for w in want)


def test_longest_matches(spark):
    """Whole matches with their places, in a document that has two of one item and a repeat of a part."""
    item = [f"a{i}" for i in range(40)]
    text = ["x", "y", *item[5:30], "z", *item[20:40], *item[20:31]]
    table = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item[:9])), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "a7 A8")], "item_id long, text string")
    for block in (10**6, 1):
        found = {r["doc_id"]: r for r in decontam.judge(table, items, block_words=block).collect()}
        got = sorted((m["item_id"], m["item_start"], m["doc_start"], m["words"]) for m in found[1]["matches"])
        assert got == [("1", 5, 2, 25), ("1", 20, 28, 20), ("1", 20, 48, 11), ("2", 0, 4, 2)]
        assert found[1]["longest_match"] == 25 and found[1]["n_hit"] == 56 and [tuple(x) for x in found[1]["spans"]] == [(2, 27), (28, 59)]
        assert found[2]["items"] == ["2"] and found[2]["n_hit"] == 2 and found[None]["matches"] == []


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        codes = rng.integers(1, 4, n)
        first = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]])
        end = first[1:][np.repeat(np.arange(4), np.diff(first))]
        order = decontam.suffix_array(codes, end)
        suffixes = [tuple(codes[i : end[i]]) for i in order]
        assert sorted(order) == list(range(n)) and suffixes == sorted(suffixes)


def test_language_prefers_the_right_one(docs, odd, nothing):
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).where(langid.held_out(F.col("doc_id"))).where(F.length("text") > 100).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    for table in (odd, nothing):
        marked = langid.identify(table, model)
        for r in marked.collect():
            letters = any(c.isalpha() for c in r["text"] or "")
            assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
        kept = langid.accepted(table, model)
        assert kept.columns == table.columns and all(any(c.isalpha() for c in r["text"] or "") for r in kept.collect())
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(nothing)).collect()} == {"und"}
    assert langid.accepted(odd, langid.fit(nothing)).count() == 0


def test_only_wanted_and_fitting_languages_stay(spark, docs):
    """Clean documents stay; a text of another script or of noise goes, and so does an unwanted language."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    whole = docs.where(F.col("text").rlike(r"\p{L}"))
    assert langid.accepted(docs, model).count() >= 0.995 * whole.count()
    rng = np.random.default_rng(1)
    noise = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(100))
    rows = [(1, "слово и дело " * 40), (2, noise), (3, docs.where("lang = 'de' and length(text) > 500").first()["text"]), (4, "the")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in langid.accepted(table, model).collect()} == {3, 4}
    assert {r["doc_id"] for r in langid.accepted(table.where("doc_id = 3"), model, ["en", "fr"]).collect()} == set()
    assert {r["doc_id"] for r in langid.accepted(table.where("doc_id = 3"), model, ["de"], 0.01).collect()} == {3}


def test_learns_from_anywhere_in_a_text(spark):
    """One row per language, without an id: pieces come from all of it, about as many as asked for."""
    rows = [(None, "aa bb cc " * 2000 + "zyx wvu " * 2000, "p"), (None, "dd ee " * 4000, "q")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces=20)
    assert model.languages == ["p", "q"] and all(5 * 400 < 2**b < 40 * 400 for b in model.bits)
    assert {chr(c) for c in model.known} >= set("abczyxwvude")


@pytest.mark.parametrize("block", [3, 7, 512])
def test_cross_parsing(block, monkeypatch):
    """Phrases are the longest matches that the training text has, letter by letter, in texts of any length."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(3)
    train = ["abracadabra alakazam" * 3, "the quick brown fox " * 3, "ab" * 30]
    model = langid.Model({"x": [train[0]], "y": [train[1]], "z": [train[2]]})
    lower = langid.letters()
    texts = ["abrakazam", "quack the brown zebra", "q", "fox", "ab" * 700, "abracadabra" * 100, "".join(rng.choice(list("abck fox"), 2000)), "".join(rng.choice(list("ab"), 3000))]
    symbols = [model.classes(lower[np.array([ord(c) for c in t])]) for t in texts]
    got = model.parse(np.concatenate(symbols), np.array([len(x) for x in symbols]))
    for i, text in enumerate(texts):
        plain = re.sub(" +", " ", text).lstrip()
        assert got[:, i].tolist() == [plain_phrases(plain, t) for t in train]


def test_large_alphabets_take_little_room():
    word = "".join(chr(0x4E00 + i) for i in np.random.default_rng(2).integers(0, 6000, 9000))
    model = langid.Model({"zh": [word], "en": ["the quick brown fox " * 50]})
    assert model.slots.nbytes + model.base.nbytes < 4e6
    assert model.parse(model.classes(langid.letters()[np.array([ord(c) for c in word[100:140]])]), np.array([40]))[1, 0] == 1


def test_media_round_trip(table):
    rows = {}
    for r in media.read_back(media.stored_texts(table)).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    want = {}
    for r in table.select("doc_id", "text").collect():
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        want.setdefault(r["doc_id"], []).append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert {k: sorted(tuple(r)[1:5] for r in v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("lacing", ["fixed", "xiph", "ebml"])
def test_matroska(lacing):
    payload = bytes(np.random.default_rng(1).integers(0, 256, 576 * 300, dtype=np.uint8))
    data = media.muxed(payload, lacing)
    found, cues = media.packets(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in found) == payload
    assert [p.timestamp for p in found] == [72 * i for i in range(300)]
    assert all(data[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in cues) and len(cues) == 3


def test_matroska_by_hand():
    """Unknown sizes, uneven laces, a block group, several tracks."""
    frames = [b"a" * 3, b"b" * 700, b"c" * 20, b"d"]
    parts = [media.element(media.TIMESTAMP, 500)]
    for lacing in ("xiph", "ebml"):
        flags, body = media.laced(frames, lacing)
        parts.append(media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x82\xff\xfe" + bytes([flags]) + body)))
    cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + b"".join(parts)
    data = media.HEADER + media.SEGMENT.to_bytes(4, "big") + b"\xff" + media.TRACK + cluster + cluster
    found, _ = media.packets(data)
    assert [data[p.offset : p.offset + p.size] for p in found] == frames * 4
    assert {(p.track, p.timestamp) for p in found} == {(2, 498)}


def test_packet_table(odd):
    table = media.packet_table(media.stored_texts(odd.where("doc_id = 6"))).collect()
    assert all(r["size"] == 576 and r["track"] == 1 for r in table) and [r["packet"] for r in table] == list(range(len(table)))


def test_simple_8b():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1023, 1024, 1025, 9000):
        for high in (1, 2, 60, 49_000, 2**31, 2**60, 2**64):
            ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=False) if high < 2**64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
            ids[rng.random(n) < 0.3] = 0
            assert np.array_equal(tokens.ids_of(tokens.segment(ids)), ids)


def test_segment_of_documents():
    ids = np.arange(70_000, dtype=np.uint64) % 50_000
    for doc_ids, counts in (([], []), ([None, -5, 7, 7], [1, 0, 69_000, 999]), (list(range(10)), [7000] * 10)):
        own = ids[: sum(counts)]
        found = tokens.documents_of(tokens.file_segment(doc_ids, np.array(counts, np.int64), own, 12))
        assert [None if n else d for d, n in zip(found[0].tolist(), found[1].tolist(), strict=True)] == doc_ids
        assert found[2].tolist() == counts and np.array_equal(found[3], own) and found[4] == 12


def test_simple_8b_by_hand():
    words, offsets = tokens.pack(np.array([1, 2, 3, 2**62], np.uint64))
    assert offsets.tolist() == [0, 3 if len(words) == 3 else len(words)]
    assert words[-1] == 2**62 and words[-2] >> np.uint64(60) == 0


def test_token_ids(table):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    want = []
    for r in table.select("doc_id", "text").collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted((tuple(r) for r in tokens.packed(table).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter(want)


def test_token_ids_of_other_scripts(spark):
    """Lower-casing goes by character: a capital sigma at the end of a word is no final one."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["ΟΔΟΣ", "ΑΣ", "ΑΣ, ΟΔΟΣ. οδος", "ΣΑΣ!", "İSTANBUL ǅ ẞ ΐ", "Größe, СЛОВО; 字。", "plain ΑΣx ΑΣ1"]
    got = tokens.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_other_tokenizer_gets_whole_texts(odd):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tokens.Encoder(path).by_piece and tokens.encoder(tokens.default_tokenizer()).by_piece
    assert tokens.packed(odd, path).count() == odd.count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


ODD_PII = [
    "a@b", "a@b.c@d.e x@y.z", "mail x.y+1@q-r.example.com.", "@a.b", "..@a.b..c", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1 1.2.3", "4532015112830366", "4532 0151-1283 0366",
    "+1 (988) 555-2485", "+1  )", "+12345678901234567", "é+44 20 7946 0958é", "", "+1 234 567 8+9 876 543 21", "4532015112830366 4532015112830366", "a@" * 50 + "b.c",
]


def test_base_spans(docs):
    for text in [*ODD_PII, *(r["text"] or "" for r in docs.collect())]:
        assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_are_scanned_in_line():
    for text in ["1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000]:
        pii.base_spans(text)


def test_pii_rows(table):
    for r, t in zip(by_row(pii.find(table), "doc_id", "n_email", "base_sha256", "spans"), by_row(table, "doc_id"), strict=True):
        assert r[0] == t[0]
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect() if r["doc_id"] is not None}
    for r in pii.find(table).where("doc_id is not null").collect():
        base = pii.listed(plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_tagger_on_held_out_windows():
    x, y = pii.labelled(300, 999)
    tags, _ = pii.trained().decode(x)
    truth = y > 0
    assert (tags[truth] == y[truth]).mean() > 0.93 and (tags[~truth] == 0).mean() > 0.97


#: Forms that the generator doesn't make, alone, at a text's end or within it.
OTHER_FORMS = [
    "call 312 5550 0199 now", "1 312 555 0199", "my number is 312-5550-0199 thanks", "phone 312-555-0199", "reach (312)555-0199 or not", "card 3782-822463-10005", "jane.doe [at] example [dot] org",
    "write jane(at)example.org soon", "host 10[.]0[.]0[.]7 down", "addr 2001:db8:85a3::8a2e:370:7334 up", "378282246310005", "Fax 030 1234567", "01 23 45 67 89", "Kontakt: 0221/4710815", "bob_smith [at] web.de",
    "3714 496353 98431", "(020) 7946 0958", "415.555.2671", "ph 415 555 2671", "ip 192[.]168[.]1[.]254, ok",
]
OTHER_DECOYS = [
    "Version 2.0, 2024-01-02, 12:30, $45.99, AKIA3HJLEK222", "on 12/03/2024 at 10:15:33 we had 1 234 567 rows", "123-45-6789", "ISBN 978-3-16-148410-0", "order 1234567890", "range 1990-1999 and 10-20-30", "now", "it is 5",
    "see section 3.2.1 (page 45)", "1,234,567.89", "555-5036", "", "@ home (at) last", "sha 9dd3c80004c73dc9e548fee51b23b527780d4f20",
]


def test_model_on_forms_it_was_not_shown():
    added = lambda texts: [pii.all_spans(t, pii.base_spans(t), p) for t, p in zip(texts, pii.model_spans(pii.trained(), texts), strict=True)]
    assert sum(map(bool, added(OTHER_FORMS))) >= 0.9 * len(OTHER_FORMS)
    assert sum(map(bool, added(["word " * 30 + t for t in OTHER_FORMS]))) >= 0.9 * len(OTHER_FORMS)
    assert sum(map(bool, added(OTHER_DECOYS))) <= 1


def test_viterbi_against_all_paths(monkeypatch):
    from itertools import product

    monkeypatch.setattr(pii, "WINDOW", 4)
    tagger = pii.Tagger(9)
    tagger.p["moves"] = np.random.default_rng(1).standard_normal(tagger.p["moves"].shape).astype(np.float32)
    x = np.random.default_rng(2).integers(0, pii.SYMBOLS, (5, 4))
    scores, moves = tagger.emissions(x), tagger.p["moves"]
    tags, more = tagger.decode(x)
    for k in range(5):
        total = lambda path, k=k: sum(scores[t, k, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        best = max(product(range(pii.TAGS), repeat=4), key=total)
        assert tuple(tags[k]) == best
        assert abs(more[k].sum() - (total(best) - total((0, 0, 0, 0)))) < 1e-3


def test_reconciling_against_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(100):
        spans = [(float(rng.integers(1, 20)), int(a := rng.integers(0, 12)), int(a + rng.integers(1, 5)), pii.KINDS[int(rng.integers(0, 4))]) for _ in range(int(rng.integers(0, 8)))]
        apart = lambda own: all(b <= c for (_, _, b, _), (_, c, _, _) in zip(own, own[1:]))
        subsets = (sorted((s for i, s in enumerate(spans) if m >> i & 1), key=lambda s: s[1]) for m in range(1 << len(spans)))
        best = max((sum(s[0] for s in own) for own in subsets if apart(own)), default=0)
        score = {(k, a, b): max(s for s, *r in spans if r == [a, b, k]) for _, a, b, k in spans}
        got = pii.reconciled(spans)
        assert sum(score[g] for g in got) == best and all(b <= c for (_, _, b), (_, c, _) in zip(got, got[1:]))


def test_model_adds_spans(spark):
    rows = [(1, "call (988) 555-2485 or 312-555-0199 now"), (2, "card 378282246310005 here"), (3, "Version 2.0, 2024-01-02, 12:30, $45.99, AKIA3HJLEK222"), (4, "word " * 100 + "reach me at 415-555-2671 tomorrow " + "word " * 100)]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "phone:5:19" in found[1] and "phone:512:524" in found[4] and "card:5:20" in found[2] and found[3] == ""


def test_gradients():
    tagger = pii.Tagger(3)
    x, y = pii.labelled(4, 5)
    _, g = tagger.step(x, y)
    for name in ("e", "wl", "ur", "out", "moves", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, ends = tagger.p[name][at], []
        for d in (0.01, -0.01):
            tagger.p[name][at] = keep + d
            ends.append(tagger.step(x, y)[0])
        tagger.p[name][at] = keep
        assert abs((ends[0] - ends[1]) / 0.02 - g[name][at]) < 0.05 * abs(g[name][at]) + 0.01


def test_language_model(table):
    rows = [(r["doc_id"], [*BLANKS.findall((r["text"] or "").translate(LOWER)), None]) for r in table.select("doc_id", "text").collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(t for d, ts in rows if not held(d) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted([(d is not None, d or 0, held(d), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for d, ts in rows])
    found = lm.score(table).collect()
    got = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found])
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(abs(g[-1] - w[-1]) < 1e-3 for g, w in zip(got, want, strict=True))
    assert all(r["score"] < 0 for r in found)


def test_language_model_learns_order(spark):
    """Where the next word follows from the last one, the model must beat the counts on held-out texts."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        at, words = int(rng.integers(0, 30)), []
        for _ in range(80):
            words.append(f"w{at}")
            at = (at * 7 + 3 + int(rng.integers(0, 2))) % 30
        rows.append((i, " ".join(words)))
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) * 0.6


def test_language_model_beats_the_counts(docs):
    """On held-out documents, per token and in sum; the reason to have it."""
    found = lm.score(docs).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_weight_rows_follow_the_vocabulary_without_limit():
    assert lm.rows_for(0) == lm.rows_for(1000) == lm.ROWS
    for distinct in (1 << k for k in range(20, 41)):
        assert lm.rows_for(distinct) == max(lm.ROWS, distinct // 512)


def test_tasks_send_no_more_than_half_the_token_numbers():
    assert lm.tasks_for(8, 6, 1 << 30, 1 << 21) == 12 and lm.tasks_for(240, 6, 1 << 35, 1 << 24) == 60
    assert lm.tasks_for(240, 6, 1 << 30, 1 << 27) == 4 and lm.tasks_for(8, 6, 0, 1 << 21) == 1


def test_many_weight_rows_are_learned_whole(spark):
    """65,536 rows a softmax, in pieces, from two tasks a round: the mean by tokens of what plain loops learn."""
    rng, many = np.random.default_rng(8), 1 << 16
    rows = [(i, False, " ".join(f"w{k}" for k in rng.integers(0, 9000, 400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, held boolean, text string").repartition(6, "doc_id")
    parts = lm.stored(lm.chunks(docs), "lm-test")
    classes = lm.units(lm.stored(lm.counted(parts, 2), "lm-test"))
    limit = 2 * 2 * lm.Weights(many).flat().nbytes  # as if there were so many bytes: two tasks
    found = lm.trained(parts, classes, limit, many)
    assert found.many == many
    flat = lm.Weights(many).flat()
    for r in range(lm.ROUNDS):
        total, seen_by_all = np.zeros(len(flat)), 0
        for part in parts.where(parts["round"] == r).coalesce(2).rdd.glom().collect():
            w, seen = lm.Weights.of(flat.copy()), 0
            squares = np.ones((2 * many + 17, 16), np.float32)
            for row in part:
                words, index = np.frombuffer(row["vocabulary"], np.uint64), np.frombuffer(row["tokens"], "<u4")
                lm.learn(w, squares, words[index], np.frombuffer(row["first"], "<i8"), classes.of(words)[index])
                seen += len(index)
            total += (w.flat() - flat).astype(np.float64) * seen
            seen_by_all += seen
        if seen_by_all:
            flat = (flat + total / seen_by_all).astype(np.float32)
    assert (found.rows[:many] != 0).any(1).sum() > 15_000 and (found.rows[many:] != 0).any(1).sum() > 15_000
    assert np.abs(found.flat() - flat).max() < 1e-5


def test_a_very_long_text_is_scored(spark):
    rows = [(i, "a b c d " * (200_000 if i == 3 else 5)) for i in range(12)]
    found = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3]["n_tokens"] == 800_001 and all(r["score"] < 0 for r in found.values())


def test_probabilities_sum_to_one():
    """Over all tokens of the vocabulary and one that is unseen in each tail."""
    rng = np.random.default_rng(6)
    w = lm.Weights(lm.ROWS, rng.standard_normal((2 * lm.ROWS, 16)).astype(np.float32), rng.standard_normal((17, 16)).astype(np.float32))
    words = np.unique(rng.integers(1, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    count = rng.integers(1, 50, len(words))
    most = np.lexsort((words, -count))[: lm.HEADS]
    tails = np.concatenate([np.bincount(lm.tail_of(words), count, lm.TAILS), np.bincount(lm.tail_of(words), minlength=lm.TAILS)]).astype(np.int64)
    classes = lm.Units([(int(words[k]), int(count[k])) for k in most], tails)
    assert classes.tokens.sum() == count.sum() and classes.distinct.sum() == len(words)
    unit, total = classes.of(words), 0.0
    at_head = set(most.tolist())
    assert all((unit[k] < lm.HEADS) == (k in at_head) for k in range(len(words)))
    by_unit = np.zeros(lm.UNITS)
    for u in range(lm.UNITS):
        own = np.array([0, 0, u], np.int64)
        by_unit[u] = math.exp(lm.unit_scores(w, np.array([123, 456, 7], np.uint64), np.array([0, 3]), own)[2])
    assert abs(by_unit.sum() - 1) < 1e-4
    share = (count + 0.5) / (classes.tokens + 0.5 * (classes.distinct + 1))[unit]
    total = (by_unit[unit] * share).sum() + sum(by_unit[u] * 0.5 / (classes.tokens[u] + 0.5 * (classes.distinct[u] + 1)) for u in range(lm.UNITS))
    assert abs(total - 1) < 1e-4
