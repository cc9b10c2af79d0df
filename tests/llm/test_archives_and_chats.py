"""WARC archives and chat transcripts on odd rows."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

from impactlens.llm import chat, warc

PAGES = "page_id long, url string, html string, sha1 string, bytes string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def assembled(spark, rows, tmp_path, least=0):
    folder = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, PAGES), folder, least, file_bytes=2000)
    return warc.assemble(warc.read(spark, folder)).collect()


def test_transactions(spark, tmp_path):
    nested = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(5, "u5", "same", "x", "y"), (3, "u3", "same", "x", "y"), (None, "u", "same", "x", "y"), (7, "u7\r\nX: 1", None, "x", "y"), (8, None, "", "x", "y"), (9, "é", nested, "x", "y"), (9, "é", nested, "x", "y"), (10, "big", "ü" * 200_000, "x", "y")]
    found = assembled(spark, rows, tmp_path)
    assert len(found) == len(rows)
    assert all(r["request"] is not None and r["metadata"] is not None for r in found)
    assert Counter(r["capture"]["payload_digest"] for r in found) == Counter(sha(h) for _, _, h, _, _ in rows)
    kinds = {}
    for r in found:
        kinds.setdefault(r["metadata"]["fields"].get("page-id"), []).append(r["capture"]["type"])
    assert kinds["3"] == ["response"] and kinds["5"] == kinds[None] == ["revisit"] and sorted(kinds["9"]) == ["response", "revisit"]
    assert kinds["7"] == ["response"] and kinds["8"] == ["revisit"]
    by_id = {r["capture_id"]: r for r in found}
    for r in found:
        c = r["capture"]
        if c["type"] == "revisit":
            assert by_id[c["refers_to"]]["capture"]["payload_digest"] == c["payload_digest"]
        else:
            assert c["digest_ok"] and base64.b32encode(hashlib.sha1(c["payload"]).digest()).decode() == c["payload_digest"]


def test_small_payloads_are_responses(spark, tmp_path):
    found = assembled(spark, [(1, "a", "x", "", ""), (2, "b", "x", "", ""), (3, "c", "long enough", "", ""), (4, "d", "long enough", "", "")], tmp_path, least=5)
    assert sorted(r["capture"]["type"] for r in found) == ["response", "response", "response", "revisit"]


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], PAGES), folder)
    assert warc.assemble(warc.read(spark, folder)).count() == 0


CHATS = "conv_id long, turn long, role string, text string, segment string, turns string"


def test_roles_are_recovered(spark, sf_dir):
    raw = chat.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = chat.parse(raw, chat.fit(raw)).where("held_out").collect()
    truth = {(r["conv_id"], r["segment"]): r for r in raw.collect()}
    turns = sum(len(truth[r["conv_id"], r["segment"]]["roles"]) for r in found)
    assert sum(r["n_right"] for r in found) > 0.8 * turns


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "hi", "", ""), (1, 0, "user", "hi", "", ""), (1, 0, "user", "other", "", ""), (1, 300, "assistant", None, "", ""), (None, 0, None, None, "", ""), (2, None, "user", "x", "", ""), (3, 0, "user", "", "", ""), (4, 0, "user", "line\n\nUser: inside\n" * 500, "", "")]
    table = spark.createDataFrame(rows, CHATS)
    raw = chat.transcripts(table)
    found = chat.parse(raw, chat.fit(raw)).collect()
    assert len(found) == 6 == raw.count()  # the repeated row is a turn of its own
    assert all(r["rendered"] == chat.render([(t["role"], t["text"]) for t in r["turns"]]) for r in found)
    assert chat.parse(chat.transcripts(table.limit(0)), chat.fit(raw)).count() == 0
    assert chat.fit(chat.transcripts(table.limit(0))).turns("User: a") != []


def learned():
    lines = ["User: a", "b.", "Bot: c", "User: d", "more", "Bot: e?"]
    return chat.Model([(lines, [("user", True), ("user", False), ("assistant", True), ("user", True), ("user", False), ("assistant", True)])] * 4)


def best_states(model, lines):
    """Of all sequences of states, the one of greatest score."""
    from itertools import product

    scores = model.scores(chat.observed(lines))
    total = lambda p: model.start[p[0]] + sum(scores[i, x] for i, x in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))
    return max(total(p) for p in product(range(len(model.states)), repeat=len(lines))), total


def test_viterbi_against_all_paths():
    model, rng = learned(), random.Random(2)
    words = ["User: x", "Bot: y.", "plain", "", "More text?", "[user] z"]
    for _ in range(30):
        lines = [rng.choice(words) for _ in range(rng.randrange(1, 6))]
        best, total = best_states(model, lines)
        found = model.decode(lines)
        assert abs(total([model.states.index(s) for s in found]) - best) < 1e-9


def test_segments_are_decoded_as_one(spark, monkeypatch):
    """A long conversation gives the same turns however it is cut, also where matrices meet on several levels."""
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["Yes.", "one\ntwo", "Well:", "", "no end", "User: quoted"])) for c in (0, 6) for t in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(chat.transcripts(table))
    whole = {r["conv_id"]: r for r in chat.transcripts(table).collect()}
    want = {c: model.decode(r["transcript"].split("\n")) for c, r in whole.items()}
    score = lambda lines, states: sum(model.scores(chat.observed(lines))[i, model.states.index(s)] for i, s in enumerate(states)) + model.start[model.states.index(states[0])] + sum(model.move[model.states.index(a), model.states.index(b)] for a, b in zip(states, states[1:]))
    for segment, each in ((7, 256), (3, 2)):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        found = {}
        for r in sorted(chat.parse(chat.transcripts(table), model, each).collect(), key=lambda r: r["segment"]):
            found.setdefault(r["conv_id"], []).append(r)
        for c, parts in found.items():
            assert len(parts) == -(-40 // segment)
            lines = whole[c]["transcript"].split("\n")
            states = []
            for part in parts:
                for k, turn in enumerate(part["turns"]):
                    many = turn["text"].count("\n") + 1
                    states.append((turn["role"], not (k == 0 and part["continues"])))
                    states += [(turn["role"], False)] * (many - 1)
            if len(states) == len(lines):  # no turn whose marker stands on a line of its own
                assert abs(score(lines, states) - score(lines, want[c])) < 1e-9
            assert [t["role"] for p in parts for k, t in enumerate(p["turns"]) if not (k == 0 and p["continues"])] == [s[0] for s in want[c] if s[1]]


def test_viterbi_prefers_what_was_learned():
    model = chat.Model([(["User: a", "b", "Bot: c", "User: d"], [("user", True), ("user", False), ("assistant", True), ("user", True)])] * 5)
    assert model.turns("User: q\nw\nBot: e") == [("user", "q\nw"), ("assistant", "e")]


def record(i, body=b"x" * 1000, kind="response", more="", size=None):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r{i}>\r\n{more}Content-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A member per record, plain files, padding, blocks without a header, bytes that are no record, records cut short."""
    whole = b"".join(record(i, bytes([48 + i]) * 100_000, "request") for i in range(5))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i, bytes([48 + i]) * 100_000, "request")) for i in range(5)))
    (tmp_path / "b.warc").write_bytes(whole.replace(b"<r", b"<p"))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("c0", b"abcdef")) + b"\0" * 7 + gzip.compress(record("c1", HTTP + b"body") + record("c2", HTTP) + record("c3", b"HTTP/1.1 204 No\r\nA: b")))
    (tmp_path / "d.warc").write_bytes(b"junk WARC/ no\r\n" + record("d0", b"zz") + record("bad", b"WARC/1.0 inside", size="many") + record("d1", HTTP + b"WARC/1.0\r\n\r\n" + b"y" * 50)[:-20])
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(record("e0", b"zz")) + gzip.compress(record("e1"))[:60])
    (tmp_path / "f.warc").write_bytes(record("f0", b"zz") + b"WARC/1.0\r\nWARC-Type: resp")
    (tmp_path / "g.warc").write_bytes(b"")
    (tmp_path / "h.warc").write_bytes(record("h0", HTTP + b"ok", more=f"WARC-Payload-Digest: sha1:{sha('ok')}\r\n") + record("h1", HTTP + b"no", more=f"WARC-Payload-Digest: sha1:{sha('ok')}\r\n"))
    found = {r["record_id"].strip("<>"): r for r in warc.read(spark, str(tmp_path)).collect()}
    assert set(found) >= {*(f"{k}{i}" for k in "rp" for i in range(5)), "rc0", "rc1", "rc2", "rc3", "rd0", "rd1", "re0", "rf0", "rh0", "rh1"} and "rf1" not in found and "rbad" not in found
    payload = lambda i: bytes(found[i]["payload"])
    assert payload("rc0") == b"abcdef" and payload("rc1") == b"body" and payload("rc2") == b"" and payload("rc3") == b""
    assert found["rd1"]["whole"] is False and payload("rd1").startswith(b"WARC/1.0\r\n\r\nyyy") and found["rd0"]["whole"]
    assert found["rh0"]["digest_ok"] and found["rh1"]["digest_ok"] is False and found["rc1"]["digest_ok"] is None


def test_a_member_for_each_record_and_files_by_bytes(spark, tmp_path):
    rows = [(i, f"u{i}", hashlib.sha256(str(i).encode()).hexdigest() * 50, "x", "y") for i in range(40)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"), file_bytes=4000)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 4 and all(p.stat().st_size < 8000 for p in files)
    for p in files:
        raw, members = p.read_bytes(), []
        while raw:
            part = zlib.decompressobj(31)
            members.append(part.decompress(raw))
            raw = part.unused_data
        assert members[-1] == b"" and all(m.startswith(b"WARC/1.0\r\n") and m.count(b"WARC-Record-ID") == 1 for m in members[:-1])
        assert gzip.decompress(p.read_bytes()) == b"".join(members)


def test_large_pages(spark, tmp_path):
    rows = [(1, "a", "é" * 3_000_000, "", ""), (2, "b", "é" * 3_000_000, "", ""), (3, "c", "x", "", "")]
    found = assembled(spark, rows, tmp_path)
    assert sorted(r["capture"]["type"] for r in found) == ["response", "response", "revisit"] and max(r["capture"]["payload_bytes"] or 0 for r in found) == 6_000_000
