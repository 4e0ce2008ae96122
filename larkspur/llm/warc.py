"""Legacy archive converter: ARC files in, WARC files out, and both read back.

ARC: a version block whose third line names the url-record fields, then records
of one header line, a declared length and that many bytes. Version 1 lines are
``url ip date type length``, version 2 lines ``url ip date type status checksum
location offset file length``. Files may be gzipped, in one member or many, and
hold several archives one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Steps, by_bytes, delete_path, new_path, perhaps, prepare

# Fixed values of the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

#: Records of equal payloads become revisits from this many bytes on.
LEAST_BYTES = 0
#: Archive date of records that have none.
DATE = "20000101000000"
#: Bytes of records that are written together, at least, and such parts of a file:
#: files hold about 32 MB, or one record.
PART_BYTES, FILE_PARTS = 4 << 20, 8
#: Parts that records of one payload are dealt to when they look for their response.
SALTS = 16
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:larkspur:warc")


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    status: str
    checksum: str
    block: bytes
    error: str | None = None


def _word(value: str) -> str:
    """A header word: no blank, no control character, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def write_arc(records: Iterable[ArcRecord], version: int) -> bytes:
    """An uncompressed archive of version 1 or 2."""
    head = f"{version} 0 larkspur\n{ARC_FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 archive.arc" if version == 2 else ""
    out = [f"filedesc://archive.arc 0.0.0.0 {DATE} text/plain{extra} {len(head)}\n".encode(), head]
    for r in records:
        words = [_word(r.url), _word(r.ip), _word(r.date), _word(r.kind)]
        if version == 2:
            words += [_word(r.status), _word(r.checksum), "-", "0", "archive.arc"]
        out += [b"\n", " ".join([*words, str(len(r.block))]).encode(), b"\n", r.block]
    return b"".join([*out, b"\n"])


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records after each version block; lengths decide where a record ends.

    The version is read from the version block; until there is one, a line's
    number of words tells. Blanks in a url become %20. What is no record line
    gives one record with an ``error`` and an empty block, and reading goes on at
    the next line that is one; so does a record that its archive cuts, the last.
    """
    version, lost = 0, False
    while line := stream.readline():
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if line.startswith(b"filedesc://") and words[-1].isdecimal():
            head = stream.read(int(words[-1])).split(b" ", 1)[0].strip()
            version, lost = (int(head) if head in (b"1", b"2") else 0), False
            continue
        kind = version or (2 if len(words) >= 10 and words[-7][:1].isdigit() and words[-8].isdecimal() else 1)
        after = len(ARC_FIELDS[kind].split()) - 1  # words after the url
        tail = words[-after:]
        if len(words) <= after or not tail[1].isdecimal() or not tail[-1].isdecimal():
            if not lost:
                yield ArcRecord("", "", "", "", "", "", b"", f"no record line: {line[:80]!r}")
            lost = True
            continue
        lost, size = False, int(tail[-1])
        block = stream.read(size)
        url = "%20".join(words[:-after])
        status, checksum = tail[3:5] if kind == 2 else ("", "")
        if len(block) < size:
            yield ArcRecord(url, *tail[:3], status, checksum, b"", f"cut after {len(block)} of {size} bytes")
            return
        yield ArcRecord(url, *tail[:3], status, checksum, block)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    return read_arc(open_archive(data))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; without a head all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The same for the same page and payload, so reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{payload_digest}')}>"


def iso(date: str) -> str:
    """A 14-digit archive date as a WARC date; shorter ones are filled up."""
    d = (re.sub(r"\D", "", date) + DATE[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, page_id: int | None, refers_to: int | None) -> bytes:
    """The equivalent WARC record without its two closing line ends.

    Identifier, date, type and digests are synthesised; a revisit keeps the
    HTTP head and names the response it repeats.
    """
    head, payload = split_http(record.block)
    sha = digest(payload)
    block = head if refers_to is not None else record.block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        f"WARC-Date: {iso(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response" if head else f"Content-Type: {record.kind}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*lines, "", ""]).encode() + block


def warcinfo() -> bytes:
    """The record that describes the file."""
    block = b"software: larkspur\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, 'warcinfo')}>", f"WARC-Date: {iso(DATE)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; names are lower-cased."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record longer than its archive")
        yield headers, block


class _Inflated(io.RawIOBase):
    """A gzip file's content, inflated as it is read."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.engine, self.rest = raw, 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            if self.engine.eof:
                tail = self.engine.unused_data
                if not tail and self.at >= len(self.raw):
                    return 0
                self.engine = zlib.decompressobj(31)
                self.rest = self.engine.decompress(tail) if tail else b""
                continue
            if self.at >= len(self.raw):
                return 0
            try:
                self.rest = self.engine.decompress(self.raw[self.at : self.at + 65536])
            except zlib.error:  # a damaged member ends the archive
                self.at = len(self.raw)
                return 0
            self.at += 65536
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def open_archive(raw: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(_Inflated(raw), 1 << 16) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def _save(rows: DataFrame, path: str, end: str) -> None:
    """Spark's text writer commits the files, so a lost executor leaves no torn archive."""
    writer = rows.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", FILE_PARTS).text(path)


def write_arcs(pages: DataFrame, path: str) -> None:
    """Write pages as gzipped ARC files, archives of version 1 and 2 in turn.

    The page's number is a line of the record's HTTP head.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            ids, urls, texts = (batch.column(k).to_pylist() for k in range(3))
            head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {}\r\n\r\n"
            records = (ArcRecord(u, "0.0.0.0", DATE, "text/html", "200", "-", head.format("" if k is None else k).encode() + t.encode()) for k, u, t in zip(ids, urls, texts, strict=True))
            for part in by_bytes(records, PART_BYTES, size=lambda r: len(r.block)):
                yield pa.RecordBatch.from_arrays([pa.array([write_arc(part, 1 + i % 2).decode()], pa.string())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit("")))
    _save(rows.mapInArrow(run, "value string"), path, "\n")


_ARC = "page_id long, url string, ip string, date string, kind string, payload_bytes long, key binary, block binary, error string"


def read_arcs(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """A row per record of the ARC files under ``path``, plain or gzipped.

    page_id (of a head with one, else null), url, ip, date, kind, payload_bytes,
    key (SHA-1 of the payload), block and error: what is no record, or is cut,
    has an error, a null key and an empty block.
    """
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.binary(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in _ARC.split(", ")]
        for raw in (cell.as_py() for batch in batches for cell in batch.column(0)):
            for part in by_bytes(parse_arc(raw), PART_BYTES, size=lambda r: len(r.block)):
                rows = []
                for r in part:
                    head, payload = split_http(r.block)
                    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                    rows.append((int(page[1]) if page else None, r.url, r.ip, r.date, r.kind, len(payload), None if r.error else hashlib.sha1(payload).digest(), r.block, r.error))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    return archives.select("content").mapInArrow(run, _ARC)


def convert(records: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write a WARC record for each ARC record to gzipped files under ``path``.

    Of records with equal payloads of at least ``least`` bytes, that with the
    greatest page_id is the response and the others revisit it; a null page_id is
    a response always; records with an error are left out. Only records whose
    payload may repeat (a bitmap tells) are shuffled, those of one payload to
    several tasks. Files begin with a warcinfo record.
    """
    spark = prepare(records.sparkSession)
    with Steps(spark) as steps:
        whole = records.where("error is null")
        equal = whole.where(F.col("payload_bytes") >= least).groupBy("key").agg(F.max("page_id").alias("last"), F.count("page_id").alias("n"))
        equal = steps.write(equal.where("n > 1").select("key", "last"), "equal")
        seen = perhaps(whole.select("page_id", "url", "ip", "date", "kind", "key", "block"), equal, ["key"])
        once = seen.where("not maybe").withColumn("last", F.lit(None).cast("long"))
        salted = equal.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        many = seen.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
        refers = F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to")
        columns = ["page_id", "url", "ip", "date", "kind", "block"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[bytes]:
                for batch in batches:
                    for page, url, ip, date, kind, block, to in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                        yield to_warc(ArcRecord(url, ip, date, kind, "", "", block), page, to)

            for part in by_bytes(made(), PART_BYTES):
                value = RECORD_END.encode().join([warcinfo(), *part]).decode("utf-8", "surrogateescape")
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.string())], names=["value"])

        rows = once.select(*columns, refers).union(many.select(*columns, refers))
        _save(rows.mapInArrow(run, "value string"), path, RECORD_END)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``.

    page_id, payload_bytes, payload_digest, record_type, refers_to, record_id,
    url, date. The payload of a response is digested anew and must agree with
    its header, as must every block.
    """
    prepare(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        def rows(raw: bytes) -> Iterator[tuple]:
            for headers, block in read_warc(open_archive(raw)):
                if headers["warc-type"] == "warcinfo":
                    continue
                head, payload = split_http(block)
                sha = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(headers["x-payload-length"])
                response = headers["warc-type"] == "response"
                if headers["warc-block-digest"] != f"sha1:{digest(block)}" or response and (digest(payload), len(payload)) != (sha, size):
                    raise ValueError("digest does not agree")
                page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
                to = headers.get("x-refers-to-page")
                yield int(page[1]) if page else None, size, sha, headers["warc-type"], int(to) if to else None, headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"]

        for raw in (cell.as_py() for batch in batches for cell in batch.column(0)):
            for part in by_bytes(rows(raw), 4096, size=lambda _: 1):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return archives.select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages as ARC files in the shared folder, converted to WARC files there, which are read back: a row per page.

    A null html is an empty payload, a null url an empty address (``-``);
    repeated rows are records of their own and the greatest page_id's rows are
    all responses; an empty table gives no row; other columns are not read.
    """
    spark = pages.sparkSession
    old, path = new_path(spark, "arc"), new_path(spark, "warc")
    write_arcs(pages, old)
    convert(read_arcs(spark, old, "part-*"), path, least)
    delete_path(spark, old)
    return read_back(spark, path)
