"""Converter of legacy ARC archives to WARC, with revisit records for repeated payloads.

``write_arc`` lays pages out as ARC files of version 1 or 2, ``read_arc`` parses them, ``convert``
writes the equivalent WARC files and ``read_warc`` reads those back.  Records are found by the
lengths their headers declare, never by searching for separators, so any payload is safe.  Files are
gzip streams read piece by piece: a task holds one record at a time, not a file's content
unpacked.  One file is what one task wrote; no table passes through one task.

ARC header lines differ by version (the version block of each file names it): version 1 has five fields,
version 2 ten, with result code, checksum, location, offset and file name; the length is the
last of both.  A converted record gets an identifier made of a hash of what it stands for, the
14-digit date as ISO time, its type, and SHA-256 digests of block and payload.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
page_id is the response; the others become revisits without a body.

Defined cases: a null page is an empty payload; a null or blank url is ``about:blank``, blanks
and control characters in urls are percent-encoded; a null page_id is kept as null, always a response, and never
refers or is referred to by number; pages that repeat a page_id are records each, and equal
ones with the smallest id are all responses (no record can tell them apart); an empty table gives
archives without records and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowtrace.llm.common import checked, pinned

MIN_REVISIT = 100
CHUNK = 1 << 20
#: Names of the fields of an ARC header line, by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "page_id long, url string, ip string, date string, mime string, code int, payload binary, payload_bytes long, payload_digest string"
CRLF = b"\r\n"


def _safe_url(url: str | None) -> str:
    out = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    return out or "about:blank"


def http_message(page_id: int | None, payload: bytes) -> bytes:
    """The stored response: status line, headers (the page's number among them) and body."""
    number = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (number, len(payload), payload)


def split_message(block: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers (names in lower case), status code and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    status = lines[0].split()
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, int(status[1]) if len(status) > 1 and status[1].isdigit() else 0, body


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = b"%d 0 knowtrace\n%s\n\n" % (version, FIELDS[version].encode())
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    line += f"200 - - 0 {name} " if version == 2 else ""
    return line.encode() + b"%d\n" % len(body) + body


def arc_line(version: int, url: str, ip: str, date: str, mime: str, code: int, offset: int, name: str, length: int) -> bytes:
    extra = f"{code} - - {offset} {name} " if version == 2 else ""
    return f"{url} {ip} {date} {mime} {extra}{length}\n".encode()


class Stream:
    """Reads lines and counted bytes from a packed file, unpacking as it goes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.unpack = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + CHUNK]
        self.at += len(part)
        while self.unpack is not None and len(part):
            self.buffer += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if self.unpack.eof:  # files may be several gzip members
                self.unpack = zlib.decompressobj(31)
        if self.unpack is None:
            self.buffer += part
        return True

    def line(self) -> bytes | None:
        """Up to and without the line feed; None at the end of the file."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                out, self.buffer = bytes(self.buffer), bytearray()
                return out or None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"the file ends inside a record: {n} bytes declared, {len(self.buffer)} left")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_arc(data: bytes) -> Iterator[dict]:
    """url, ip, date, mime, code, block of each record; the version block decides the fields."""
    s = Stream(data)
    version = 1
    while (raw := s.line()) is not None:
        if not raw.strip():
            continue
        parts = raw.decode("utf-8").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            version = int(s.take(int(parts[-1])).split(None, 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if len(parts) != len(FIELDS[version].split()):
            raise ValueError(f"an ARC version {version} header has {len(FIELDS[version].split())} fields: {raw[:200]!r}")
        url, ip, date, mime = parts[:4]
        yield {"url": url, "ip": ip, "date": date, "mime": mime, "code": int(parts[4]) if version == 2 else None, "block": s.take(int(parts[-1]))}


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record."""
    s = Stream(data)
    while (raw := s.line()) is not None:
        if not raw.strip():
            continue
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {raw[:80]!r}")
        fields = {}
        while (raw := s.line()) and raw.strip():
            k, _, v = raw.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip(" \t\r")
        yield fields, s.take(int(fields["content-length"]))


def _lines(df: DataFrame, path: str, end: str) -> None:
    """Write one binary column as records that end with ``end``: a packed file a task."""
    df.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None, date: str = "20040229120000") -> None:
    """One ARC file a task under ``path``; version None alternates between both by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        v, name = version or part % 2 + 1, f"part-{part:05d}.arc.gz"
        head = arc_head(v, name, date)[:-1]  # the writer ends every record with a line feed
        at, first = len(head) + 1, [head]
        for b in batches:
            rows = first
            first = []
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                block = http_message(page_id, html or b"")
                rows.append(arc_line(v, _safe_url(url), "0.0.0.0", date, "text/html", 200, at, name, len(block)) + block)
                at += len(rows[-1]) + 1
            yield pa.record_batch([pa.array(rows, pa.binary())], ["record"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    _lines(rows.mapInArrow(run, "record binary").select(F.col("record").cast("string")), path, "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 8 MB; the size of a row is its first value."""
    held, size = [], 0
    for n, *row in rows:
        held.append(row)
        size += n
        if size > 8 << 20 or len(held) >= 2000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def _schema(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in ddl.split(", ")]
    return [a for a, _ in pairs], [_KINDS[b] for _, b in pairs]


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORD: one row a record of the ARC files; ``payload`` is null unless asked for."""
    names, kinds = _schema(RECORD)

    def parsed(data: bytes) -> Iterator[tuple]:
        for r in parse_arc(data):
            fields, code, body = split_message(r["block"])
            number = fields.get("x-page-id")
            digest = hashlib.sha256(body).hexdigest()
            yield (len(body) if with_payload else 0, int(number) if number else None, r["url"], r["ip"], r["date"], r["mime"], r["code"] or code, body if with_payload else None, len(body), digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _batches(parsed(data.as_py()), names, kinds)

    return _files(spark, path).mapInArrow(run, RECORD)


def record_id(*what: object) -> str:
    """An identifier that depends on what the record stands for alone (a version-8 UUID)."""
    raw = bytearray(hashlib.sha256("\x1f".join(map(str, what)).encode()).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x80, raw[8] & 0x3F | 0x80
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(raw))}>"


def warc_record(page_id: int | None, url: str, ip: str, date: str, mime: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit with the headers only, equivalent to one ARC record."""
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = http_message(page_id, payload)
    if revisit:
        block = block[: len(block) - len(payload)]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, date, digest)),
        ("WARC-Date", when),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", ip),
        ("WARC-Identified-Payload-Type", mime),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", when)]
        fields += [] if refers_to is None else [("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + block


def revisits(spark: SparkSession, arc_path: str) -> DataFrame:
    """of (a payload's digest), refers_to: payloads of MIN_REVISIT bytes or more that occur again."""
    seen = pinned(read_arc(spark, arc_path, with_payload=False).where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest", "payload_bytes"), "payloads")
    first = seen.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return pinned(first.select(F.col("payload_digest").alias("of"), "refers_to"), "repeated-payloads")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Read ARC files, write WARC files: one file a task, the warcinfo record first."""
    repeated = checked(revisits(spark, arc_path))
    arc = read_arc(spark, arc_path).join(repeated, (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") >= MIN_REVISIT), "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: knowtrace\r\nformat: WARC File Format 1.1\r\n"
        head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: 2004-02-29T12:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s"
        first = [head % (record_id("warcinfo").encode(), len(info), info)]
        for b in batches:
            rows = first
            first = []
            for r in b.to_pylist():
                again = r["refers_to"] is not None and r["page_id"] not in (None, r["refers_to"])
                rows.append(warc_record(r["page_id"], r["url"], r["ip"], r["date"], r["mime"], r["payload"], r["payload_digest"], r["refers_to"] if again else None, again))
            yield pa.record_batch([pa.array(rows, pa.binary())], ["record"])

    rows = arc.select("page_id", "url", "ip", "date", "mime", "payload", "payload_digest", "refers_to")
    _lines(rows.mapInArrow(run, "record binary").select(F.col("record").cast("string")), warc_path, "\r\n\r\n")


READ = "page_id long, url string, date string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ: one row a response or revisit; length and digest are those of the full payload.

    A response's are computed from its body and held against its headers; a revisit's are the ones it states.
    """
    names, kinds = _schema(READ)

    def parsed(data: bytes) -> Iterator[tuple]:
        for fields, block in parse_warc(data):
            if fields["warc-type"] not in ("response", "revisit"):
                continue
            http, _, body = split_message(block)
            stated = fields["warc-payload-digest"].partition(":")[2]
            if fields["warc-type"] == "response":
                n, digest = len(body), hashlib.sha256(body).hexdigest()
                if digest != stated:
                    raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
            else:
                n, digest = int(http["content-length"]), stated
            number, refers = http.get("x-page-id"), fields.get("x-refers-to-page-id")
            yield (200, int(number) if number else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-type"], fields["warc-record-id"], n, digest, int(refers) if refers else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _batches(parsed(data.as_py()), names, kinds)

    return _files(spark, path).mapInArrow(run, READ)
