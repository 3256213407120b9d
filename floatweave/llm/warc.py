"""WARC archives: writing records of pages, and reading them with segment reassembly.

Archives are written by Spark's text writer with the record end as line
separator, so every file in the folder is a valid archive, gzipped, in whatever
store Spark reaches. Payloads travel in HTTP messages with chunked transfer
framing. A block longer than ``segment_bytes`` is cut: the first part stays in
the response record, the others become continuation records that name its
identifier and their segment number, the last also the total length.

Reading: files are parsed one by one; whole records are decoded where they are
parsed, and only the parts of segmented records are shuffled, grouped by origin
identifier, put in order, checked against the total length and decoded.

Of pages with equal payloads of ``revisit_bytes`` or more, the one with the
largest id is a response and the others are revisits that refer to it.

Cases: a null payload is an empty one; null ids are kept (a null id is the
smallest); rows of equal id and payload are all responses when that id is the
largest; extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

END = "\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def _head(kind: str, fields: list[tuple[str, str]], length: int) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Date", _DATE), ("Content-Length", str(length))]) + "\r\n"


def _utf8_cuts(block: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes that end between characters, as the writer takes text."""
    parts, at = [], 0
    while at < len(block):
        to = min(len(block), at + size)
        while to < len(block) and block[to] & 0xC0 == 0x80:
            to += 1
        parts.append(block[at:to])
        at = to
    return parts


def records(page_id: int | None, url: str, payload: bytes, refers: int | None, is_revisit: bool, segment_bytes: int) -> Iterator[str]:
    """The records of one page, each without its end mark."""
    hexed = hashlib.sha1(payload).hexdigest()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()
    own = [("WARC-Record-ID", record_id(page_id, hexed)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("X-Page-ID", "" if page_id is None else str(page_id))]
    http = "Content-Type", "application/http; msgtype=response"
    if is_revisit:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, hexed)), ("X-Refers-To-Page-ID", str(refers))]
        block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
        yield _head("revisit", [*own, http], len(block)) + block.decode()
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked_text(payload)
    if len(block) <= segment_bytes:
        yield _head("response", [*own, http], len(block)) + block.decode()
        return
    parts = _utf8_cuts(block, segment_bytes)
    yield _head("response", [*own, http, ("WARC-Segment-Number", "1")], len(parts[0])) + parts[0].decode()
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{hexed}:{k}')}>"), ("WARC-Segment-Origin-ID", own[0][1]), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _head("continuation", more, len(part)) + part.decode()


def chunked_text(payload: bytes, size: int = 8192) -> bytes:
    """Chunked framing whose chunks end between characters: the archive stays text."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _utf8_cuts(payload, size)) + b"0\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        to = data.index(b"\r\n\r\n", at)
        lines = data[at:to].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[to + 4 : to + 4 + n]
        if len(block) != n or data[to + 4 + n : to + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block
        at = to + 8 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, segment_bytes: int = 32_768, file_bytes: int = 64_000_000) -> None:
    """Write an archive set of ``pages`` at ``path``."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # only digests and ids are grouped; a payload seen once needs no partner
    own = src.filter(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    shared = stash(own.filter("n > 1 and best is not null").select("digest", "best"), "shared-payloads")
    marked = src.join(shared, "digest", "left").withColumn("revisit", F.expr("best is not null and not (page_id <=> best)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(batch.column(k).slice(at, 256).to_pylist() for k in range(5)))
                made = [r for page, url, html, best, revisit in rows for r in records(page, url.translate({10: None, 13: None}), html.encode(), best, revisit, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    lines = marked.select("page_id", "url", "html", "best", "revisit").mapInArrow(run, "value string")
    per_file = max(1, file_bytes // segment_bytes)  # no record is longer, so no file is much longer than file_bytes
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload, digest, record_type, refers_to) of each response and revisit of an archive
    set; a revisit has no payload, and ``digest`` (SHA-1 in hex) is that of its header. Raises on a record that is cut short or whose parts fail
    their total length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload", "digest", "record_type", "refers_to", "origin", "segment", "total", "part"]
        kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        number = lambda v: int(v) if v else None

        def rows(data: bytes):
            for f, block in parse(data):
                kind, page = f["warc-type"], number(f.get("x-page-id"))
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                digest = base64.b32decode(digest).hex() if digest else None
                if kind == "continuation":
                    yield None, None, None, kind, None, f["warc-segment-origin-id"], int(f["warc-segment-number"]), number(f.get("warc-segment-total-length")), block
                elif kind == "revisit":
                    yield page, None, digest, kind, number(f.get("x-refers-to-page-id")), None, None, None, None
                elif kind == "response":
                    if "warc-segment-number" in f:
                        yield page, None, digest, kind, None, f["warc-record-id"], 1, None, block
                    else:
                        yield page, payload_of(block), digest, kind, None, None, None, None, None

        def out(some):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for item in batch.column(0):
                data, some = item.as_py(), []
                for r in rows(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    some.append(r)
                    if len(some) >= 500:
                        yield out(some)
                        some = []
                if some:
                    yield out(some)

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, total, parts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                by_number = {p["segment"]: p["part"] for p in parts}
                block = b"".join(by_number[k] for k in sorted(by_number))
                if sorted(by_number) != list(range(1, len(by_number) + 1)) or len(block) != total:
                    raise ValueError("a segmented record fails its total length")
                body = payload_of(block)
                n = len(pages)  # rows of equal id and payload share an identifier: each is a record
                yield pa.RecordBatch.from_arrays([pa.array([p["page_id"] for p in pages], pa.int64()), pa.array([body] * n, pa.binary()), pa.array([p["digest"] for p in pages], pa.string()), pa.array(["response"] * n), pa.array([None] * n, pa.int64())], ["page_id", "payload", "digest", "record_type", "refers_to"])

    schema = "page_id long, payload binary, digest string, record_type string, refers_to long, origin string, segment long, total long, part binary"
    parsed = stash(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), "warc-records")
    whole = parsed.filter("origin is null").select("page_id", "payload", "digest", "record_type", "refers_to")
    grouped = parsed.filter("origin is not null").groupBy("origin").agg(
        F.expr("collect_list(struct(page_id, digest)) filter (where segment = 1)").alias("pages"), F.max("total").alias("total"), F.collect_set(F.struct("segment", "part")).alias("parts")
    )
    rebuilt = grouped.select("pages", "total", "parts").mapInArrow(join_parts, "page_id long, payload binary, digest string, record_type string, refers_to long")
    return whole.unionByName(rebuilt)


def resolved(records_read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit's payload is that of
    the page it refers to, with the digest that the revisit names."""
    own = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest"))
    seen = records_read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), own.alias("payload_digest"), "record_type", "refers_to")
    seen = stash(seen, "warc-seen")
    first = seen.filter("record_type = 'response'")
    target = first.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    again = seen.filter("record_type = 'revisit'").drop("payload_bytes").join(stash(target, "warc-targets"), ["refers_to", "payload_digest"], "left")
    return first.unionByName(again.select(first.columns))
