"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

`write` makes WARC/1.0 files of gzip members, one for each record, in a folder, through Spark's own writer. `read` goes
through an archive member by member and parses every record by its Content-Length. `assemble` joins the records of a
transaction through WARC-Concurrent-To: one nested row per capture.

Semantics
- A null html is an empty payload. Of records with equal payloads of at least `least` bytes, the one with the smallest
  page_id (null last; of equal ids any one) is the response; the others are revisits without a body that refer to it.
  Smaller payloads are all responses. Repeated rows are captures of their own.
- A capture without request or metadata record has null there; a request or metadata record without its response is
  no capture. Of several requests for one response, that with the least record id counts.
- Line breaks in a url are percent-encoded. An empty table gives empty folders and an empty result; columns other than
  page_id, url and html are ignored.
- A file ends with the record that brings it to `FILE_BYTES` or more, so one file is small enough to be read as a whole.
- `read` takes gzip files of any number of members and plain ones. A payload is what follows the HTTP header; a block
  without one is the payload as a whole. A record that its archive ends in is given with what is there of it and isn't
  `whole`; one whose header is cut short, and bytes that are no record, are passed over. digest_ok says whether a
  payload has the digest that its record claims, null if it claims none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.llm.common import shared_path, tidy

FILE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, digest_ok boolean, whole boolean, fields map<string,string>, payload binary"
)


def member(data: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: A gzip member that holds nothing; the writer ends each file with it.
NOTHING = member(b"")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(kind: str, row: int) -> str:
    h = hashlib.md5(f"{kind}:capture:{row}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, rid: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; headers whose value is None are left out."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def transaction(page_id: int | None, url: str, html: bytes | None, sha1: bytes, size: int, row: int, first: int | None) -> list[bytes]:
    """A capture's records. first: the row whose response it revisits, if another one; its html isn't needed then."""
    rid, uri = record_id("response", row), url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    about = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    again = first is not None
    return [
        record("request", record_id("request", row), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\n\r\n".encode()),
        record(
            "revisit" if again else "response", rid,
            [
                ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("WARC-Profile", PROFILE if again else None),
                ("WARC-Refers-To", record_id("response", first) if again else None), ("Content-Type", "application/http; msgtype=response"),
            ],
            head if html is None else head + html,
        ),
        record("metadata", record_id("metadata", row), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields")], about),
    ]


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, sha1, size, row, first (the row whose response a page revisits, if it does) and, if not, html."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.min(place).alias("first"))
    rows = rows.join(firsts, "sha1", "left")
    again = F.col("first.row") != F.col("row")
    html = F.when(F.coalesce(~again, F.lit(True)), F.col("html").cast("binary"))
    return rows.select("page_id", "url", html.alias("html"), "sha1", F.octet_length("html").alias("size"), "row", F.when(again, F.col("first.row")).alias("first"))


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes the archives. A row of the writer is a file's bytes; the line separator ends it with an empty member."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = (batch.column(k) for k in ("page_id", "url", "html", "sha1", "size", "row", "first"))
            for capture in zip(*columns, strict=True):
                for data in map(member, transaction(*(x.as_py() for x in capture))):
                    held.append(data)
                    size += len(data)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_pydict({"data": pa.array([b"".join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"data": pa.array([b"".join(held)], pa.binary())})

    found = captures(pages, least).mapInArrow(tidy(files), "data binary")
    text = found.select(F.col("data").cast("string").alias("value"))
    text.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(folder)


def pieces(raw: bytes) -> Iterator[bytes]:
    """What a file holds, piece by piece: all its gzip members, or itself."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while raw[at : at + 2] == b"\x1f\x8b":
        part = zlib.decompressobj(31)
        while not part.eof and at < len(raw):
            piece = raw[at : at + (1 << 16)]
            try:
                found = part.decompress(piece)
            except zlib.error:  # the rest can't be read
                return
            at += len(piece) - len(part.unused_data)
            if found:
                yield found
        while raw[at : at + 1] == b"\0":  # padding between members
            at += 1


BEGIN = re.compile(rb"WARC/\d+\.\d+\r?\n")
BLANK = re.compile(rb"\r?\n\r?\n")


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Header, block and whether it is whole of each record. No more is held than the record that is being read."""
    held, source, ended = bytearray(), pieces(raw), False

    def more() -> bool:
        nonlocal ended
        piece = None if ended else next(source, None)
        ended = piece is None
        if not ended:
            held.extend(piece)
        return not ended

    while True:
        while (begin := BEGIN.search(held)) is None:
            del held[: max(0, len(held) - 16)]  # no record begins in what is dropped
            if not more():
                return
        del held[: begin.start()]
        while (blank := BLANK.search(held)) is None:
            if not more():
                return
        lines = bytes(held[: blank.start()]).decode("utf-8", "replace").splitlines()
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = named.get("content-length", "")
        if not size.isdecimal():  # no telling where it ends: the next one is looked for behind the header
            del held[: blank.end()]
            continue
        stop = blank.end() + int(size)
        while len(held) < stop and more():
            pass
        yield named, bytes(held[blank.end() : stop]), len(held) >= stop
        del held[:stop]


def parsed(raw: bytes, with_payload: bool) -> Iterator[tuple]:
    for named, block, whole in records(raw):
        kind, payload, fields = named.get("warc-type"), None, {}
        if kind == "response":
            blank = BLANK.search(block) if block.startswith(b"HTTP/") else None
            payload = block[blank.end() :] if blank else b"" if block.startswith(b"HTTP/") else block
        elif kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)}
        digest = (named.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        read = base32(hashlib.sha1(payload).digest()) if kind == "response" else None
        yield (
            kind, named.get("warc-record-id"), named.get("warc-concurrent-to"), named.get("warc-refers-to"), named.get("warc-target-uri"), named.get("warc-date"),
            read or digest, None if payload is None else len(payload), None if read is None or digest is None else read == digest.upper(), whole, list(fields.items()), payload if with_payload else None,
        )


SCHEMA = pa.schema([
    *((n, pa.string()) for n in ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")),
    ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("whole", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def read(spark, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record of every archive in folder; payloads only if asked for, their digests always checked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        for batch in batches:
            for content in batch.column("content"):
                found, size = [], 0
                for row in parsed(content.as_py(), with_payload):
                    found.append(row)
                    size += len(row[-1] or b"")
                    if len(found) == 512 or size > 1 << 24:
                        yield table(found)
                        found, size = [], 0
                if found:
                    yield table(found)

    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder).select("content").mapInArrow(tidy(rows), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, capture (response or revisit), request, metadata, response_id."""
    key = F.when(F.col("type").isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id"))
    whole = F.struct(*(c for c in records.columns))
    of = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), whole), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    joined = records.where(key.isNotNull()).groupBy(key.alias("capture_id")).agg(of("response", "revisit").alias("capture"), of("request").alias("request"), of("metadata").alias("metadata"))
    return joined.where("capture is not null")


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = assemble(read(spark, folder, with_payload=False)).select(
        "capture_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("target"), F.col("capture.payload_bytes").alias("bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.digest_ok").alias("digest_ok"), F.coalesce("request.target_uri", "capture.target_uri").alias("target_uri"),
    )
    responses = found.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("first_id"), F.col("bytes").alias("first_bytes"))
    plain = found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri", "digest_ok")
    again = found.where("record_type = 'revisit'").join(responses, "target", "left")
    again = again.select("page_id", F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_id").alias("refers_to"), "target_uri", F.lit(None).cast("boolean").alias("digest_ok"))
    return plain.unionByName(again)


SQL = r"""
WITH p AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (10 * (k // 8) + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to, target_uri, CASE WHEN first_id = page_id THEN true END AS digest_ok
FROM q
"""
