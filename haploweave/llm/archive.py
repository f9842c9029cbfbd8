"""WARC records in ZIP packages: stored members and an index, found through the central directory and read by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, prepare, save

RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdx"
_ID = "urn:page:"
_DATE = "2020-01-01T00:00:00Z"
_U32, _U16 = 0xFFFFFFFF, 0xFFFF


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- WARC


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One gzip member with one WARC/1.1 record. A revisit keeps the payload's digest and length, not the payload."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a gzip member with one WARC record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def _page(field: str | None) -> int | None:
    text = (field or "").strip("<>").removeprefix(_ID)
    return int(text) if text else None


# ---- ZIP


class Package:
    """Writes a ZIP package to a stream that can't seek: stored members with data descriptors, ZIP64 where needed or asked for."""

    def __init__(self, out: BinaryIO, zip64: bool = False) -> None:
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.size, self.crc = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x0808, 0, 0, 33, 0, _U32, _U32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> int:
        """Offset inside the member at which data lies."""
        before = self.size
        self._put(data)
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)
        return before

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.members:
            big = self.zip64 or size >= _U32 or offset >= _U32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            small = (_U32, _U32, _U32) if big else (size, size, offset)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x0808, 0, 0, 33, crc, small[0], small[1], len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or start >= _U32 or length >= _U32 or n >= _U16:
            where = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, where, 1))
            n, length, start = _U16, _U32, _U32
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, length, start, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


def directory(f: BinaryIO, size: int) -> dict[str, Member]:
    """Members by name, from the end record, the ZIP64 records if there are any, and the central directory alone."""
    tail_at = max(0, size - 22 - _U16)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == _U16 or length == _U32 or start == _U32:
        f.seek(tail_at + at - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\6\7":
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            end = f.read(56)
            if end[:4] != b"PK\6\6":
                raise ValueError("broken ZIP64 end record")
            n, length, start = struct.unpack_from("<QQQ", end, 32)
    f.seek(start)
    raw, found, at = f.read(length), {}, 0
    for _ in range(n):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", raw, at + 10)[0]
        packed, full = struct.unpack_from("<II", raw, at + 20)
        names, extras, comment = struct.unpack_from("<HHH", raw, at + 28)
        offset = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + names].decode()
        e, stop = at + 46 + names, at + 46 + names + extras
        while e + 4 <= stop:
            kind, width = struct.unpack_from("<HH", raw, e)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", raw, e + 4))
                full = next(values) if full == _U32 else full
                packed = next(values) if packed == _U32 else packed
                offset = next(values) if offset == _U32 else offset
            e += 4 + width
        found[name] = Member(name, method, packed, offset)
        at = stop + comment
    return found


def read_range(f: BinaryIO, member: Member, offset: int, length: int) -> bytes:
    """Part of a stored member, read in place. Its local header is read for the lengths of name and extra field."""
    if member.method:
        raise ValueError(f"{member.name} is compressed: it can't be read by ranges")
    f.seek(member.header_at)
    head = f.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    f.seek(member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26)) + offset)
    return f.read(min(length, member.size - offset))


# ---- Spark


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages -> (page_id, url, html, digest, record_type, refers_to).

    Of rows with equal payloads of at least least_bytes bytes, that with the largest page_id is response (of repeated
    rows of that id the first by url) and the others revisit it; rows with a null id come last. Html crosses the network
    once, by page_id; payload groups meet as digests, as partial maxima, so that a group of any size is no hot spot.
    """
    body, key = F.coalesce("html", F.lit("")), F.coalesce("page_id", F.lit(-(1 << 63)).cast("long"))
    keyed = pages.select("page_id", key.alias("key"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("bytes"))
    thin = save(keyed.select("page_id", "key", "sha", "bytes"), "payloads")
    tops = thin.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top")
    # Only groups of two or more need to meet the rows again.
    named = thin.join(tops, "sha").select(F.col("key").alias("k"), F.col("sha").alias("s"), "top", F.lit(True).alias("shared")).distinct()
    # One exchange of html, by page: the numbering inside a page and the join both go by it (the digests are compared in
    # an expression, so that they don't become a key of the join).
    rows = keyed.repartition("key").withColumn("nth", F.row_number().over(Window.partitionBy("key", "sha").orderBy(F.col("url").asc_nulls_last())))
    out = rows.join(named, (F.col("key") == F.col("k")) & (F.instr(F.col("sha"), F.col("s")) == 1), "left")
    lead = F.col("page_id").eqNullSafe(F.col("top")) & (F.col("nth") == 1)
    revisit = F.col("shared").isNotNull() & ~lead
    return out.select("page_id", "url", "html", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_packages(planned: DataFrame, folder: str, records_each: int = 20_000, zip64: bool = False) -> DataFrame:
    """Write planned rows into ZIP packages in folder; returns the manifest (path, n_records, bytes), already materialised.

    Each task streams its rows into packages of at most records_each records; memory holds one record and the index of
    one package. A package gets a name of its own and is listed only by the task that ended well, so that what a lost or
    repeated task left behind is never read.
    """
    prepare(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        package, index, name = None, io.StringIO(), ""

        def finish() -> pa.RecordBatch:
            package.end()
            package.begin(INDEX)
            package.write(index.getvalue().encode())
            package.end()
            package.close()
            package.out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([index.getvalue().count("\n")], pa.int64()), pa.array([package.at], pa.int64())], names=["path", "n_records", "bytes"])

        n = 0
        for batch in batches:
            for page_id, url, text, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    package, index = Package(fs.open_output_stream(f"{top}/{name}"), zip64), io.StringIO()
                    package.begin(RECORDS)
                payload = text.encode()
                raw = record(kind, page_id, url, payload, digest_of(payload), refers)
                index.write(f"{package.write(raw)} {len(raw)}\n")
                n += 1
                if n == records_each:
                    yield finish()
                    package = None
        if package is not None:
            yield finish()

    return save(planned.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, n_records long, bytes long"), "manifest")


def read_packages(manifest: DataFrame, window: int = 4 << 20) -> DataFrame:
    """manifest(path, ...) -> (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    For each package: end records, central directory, index, then ranges of the stored member, neighbouring records
    joined into reads of at most `window` bytes. A response's length and digest are computed from the payload read and
    must equal its headers; a revisit's are the headers (payload null).
    """
    prepare(manifest.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def records(path: str) -> Iterator[dict]:
        fs, name = _open(path)
        with fs.open_input_file(name) as f:
            members = directory(f, f.size())
            index, store = members[INDEX], members[RECORDS]
            entries = [tuple(map(int, x.split())) for x in read_range(f, index, 0, index.size).decode().splitlines()]
            i = 0
            while i < len(entries):
                j = i + 1
                while j < len(entries) and entries[j][0] + entries[j][1] - entries[i][0] <= window:
                    j += 1
                first = entries[i][0]
                block = read_range(f, store, first, entries[j - 1][0] + entries[j - 1][1] - first)
                for offset, length in entries[i:j]:
                    fields, payload = parse_record(block[offset - first : offset - first + length])
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if kind == "response" and (digest_of(payload), len(payload)) != (digest, size):
                        raise ValueError(f"{path}: the payload at {offset} doesn't match its headers")
                    yield {"page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}
                i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                for row in records(path):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, records_each: int = 20_000) -> DataFrame:
    """Write pages(page_id, url, html, ...) to packages in the shared folder and read them back: read_packages()'s columns.

    One row per row, repeated rows and null ids too; null html counts as empty; an empty table writes no package. Other
    columns are not read. Line breaks in a url are percent-encoded in the record.
    """
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "packages")
    manifest = write_packages(plan_records(pages, least_bytes), folder, records_each)
    return read_packages(manifest)

