"""Web archives in ZIP packages: a writer of WARC records, and a reader that finds and range-reads them in place.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (each record a gzip member of
its own) and ``indexes/index.cdxj`` (a JSON line for each record with its offset and length). As members are stored, a
record's bytes lie at the member's offset plus the record's, so one range request reads it. The reader parses the end
of central directory, ZIP64 where it is needed, the central directory and the members' local headers; it never extracts.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS by the path's scheme).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import copies, cut, hot_keys, shared_dir, spread

#: Payloads from so many bytes are written once; further records revisit the first.
REVISIT_BYTES = 1000
# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
STORED, FULL32, FULL16, EXTRA64 = 0, 0xFFFFFFFF, 0xFFFF, 1
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Gaps between records that are read through instead of asked for anew.
GAP = 64 * 1024
#: Most bytes of one range request.
SPAN = 8 * 1024 * 1024


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


# --- ZIP ------------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Writes stored members one after the other to ``out``. ``zip64``: write ZIP64 records even where sizes are small."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        self.add_parts(name, [data], len(data), zlib.crc32(data))

    def add_parts(self, name: str, parts: Iterator[bytes] | list[bytes], size: int, crc: int) -> None:
        raw, big = name.encode(), self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, size, size) if big else b""
        n = FULL32 if big else size
        self.members.append((raw, crc, size, self.at))
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, STORED, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._put(p)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            big = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, at) if big else b""
            n, o = (FULL32, FULL32) if big else (size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, STORED, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, count, end = self.at - start, len(self.members), self.at
        if self.zip64 or count >= FULL16 or start >= FULL32 or size >= FULL32:
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    at: int  # of its first byte in the package


class ZipReader:
    """Reads the directory of a package, and ranges of its stored members, by ``read_at(offset, n)``."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - (1 << 16) - 22)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(struct.pack("<I", END))
        while end >= 0 and end + 22 + (struct.unpack_from("<H", tail, end + 20)[0] if end + 22 <= len(tail) else 1 << 17) > len(tail):
            end = tail.rfind(struct.pack("<I", END), 0, end)  # the signature can also occur in a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == FULL16 or length == FULL32 or start == FULL32:
            sign, _, at, _ = struct.unpack("<IIQI", read_at(tail_at + end - 20, 20))
            if sign != LOCATOR64:
                raise ValueError("ZIP64 sizes but no ZIP64 locator")
            record = read_at(at, 56)
            if struct.unpack_from("<I", record)[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._directory(read_at(start, length), count)}

    def _directory(self, data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            sign, _, _, flags, method, _, _, _, packed, size, n, extra, comment = struct.unpack_from("<IHHHHHHIIIHHH", data, at)
            if sign != CENTRAL:
                raise ValueError("broken central directory")
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            field, stop = at + 46 + n, at + 46 + n + extra
            while field + 4 <= stop:
                kind, length = struct.unpack_from("<HH", data, field)
                if kind == EXTRA64:
                    big = iter(struct.unpack_from(f"<{length // 8}Q", data, field + 4))
                    size = next(big) if size == FULL32 else size
                    packed = next(big) if packed == FULL32 else packed
                    offset = next(big) if offset == FULL32 else offset
                field += 4 + length
            head = self.read_at(offset, 30)
            if struct.unpack_from("<I", head)[0] != LOCAL:
                raise ValueError(f"no local header for {name}")
            skip = 30 + sum(struct.unpack_from("<HH", head, 26))
            yield Member(name, method, packed, offset + skip)
            at = stop + comment

    def stored(self, prefix: str, suffix: str = "") -> list[Member]:
        """Stored members by name. One that is deflated can't be read by range, so it is an error."""
        found = [m for m in self.members.values() if m.name.startswith(prefix) and m.name.endswith(suffix) and not m.name.endswith("/")]
        for m in found:
            if m.method != STORED:
                raise ValueError(f"{m.name} is not stored")
        return found

    def read(self, member: Member, at: int = 0, n: int | None = None) -> bytes:
        return self.read_at(member.at + at, member.size - at if n is None else min(n, member.size - at))


# --- WARC -----------------------------------------------------------------------------------------------------------


def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def sha1_hex(base32: str) -> str:
    return base64.b32decode(base32).hex()


def record_id(key: str) -> str:
    return f"<urn:colloquy:{key}>"


def write_record(key: str, url: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given: its block is the HTTP head alone. Gzipped."""
    uri = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "urn:none").encode()).encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_id(key).encode(), b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Target-URI: " + uri,
        b"WARC-Payload-Digest: sha1:" + sha1_base32(digest).encode(), b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode()]
    head.append(b"Content-Length: %d" % len(block))
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


@dataclass(frozen=True)
class Record:
    kind: str
    key: str
    url: str
    payload: bytes | None  # None for revisits
    payload_bytes: int
    digest: str
    refers_to: str | None


def parse_record(raw: bytes) -> Record:
    """A gzipped record. A response whose payload doesn't fit its declared digest or length is an error."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    name = lambda x: x.decode("latin-1").strip("<>").rpartition(":")[2]
    digest = sha1_hex(fields[b"warc-payload-digest"].partition(b":")[2].decode())
    kind = fields[b"warc-type"].decode()
    if kind == "response" and (declared != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a response's payload doesn't fit its digest")
    return Record(kind, name(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode("utf-8", "replace"), payload if kind == "response" else None, declared, digest, name(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None)


# --- Spark ----------------------------------------------------------------------------------------------------------


def plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: what to write for each row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the others
    refer to it. Null html is an empty payload. Rows without page_id are responses and never referred to. Rows with an
    equal payload that repeat the largest page_id are all responses. Only digests and ids are aggregated; a payload that
    many rows share is salted in the join that tells each of them its first.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    big = F.octet_length("html") >= least
    same = cut(p.where(big & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    heavy = hot_keys(same, "digest", "n")
    first = same.select(F.col("digest").alias("d"), "first", F.explode(copies(F.col("digest"), heavy)).alias("s"))
    p = p.withColumn("salt", spread(F.col("digest"), heavy, F.xxhash64("page_id", "url")))
    out = p.join(first, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & big, "left")
    refers = F.when(F.col("page_id") < F.col("first"), F.col("first"))
    return out.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(records: DataFrame, folder: str, package_bytes: int = 64 * 1024 * 1024, zip64: bool = False) -> DataFrame:
    """Write packages of up to about ``package_bytes`` of compressed records into ``folder``; one row for each: path, n_records, n_bytes.

    A package gets a name of its own and appears under it only when it is whole, so a task that is run again, because an
    executor was lost or was slow, leaves at most packages that the returned table doesn't list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = open_path(folder)
        fs.create_dir(root, recursive=True)
        parts: list[bytes] = []
        lines: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, lines, held
            name = f"{uuid.uuid4().hex}.wacz"
            crc = 0
            for x in parts:
                crc = zlib.crc32(x, crc)
            with fs.open_output_stream(f"{root}/.{name}.part") as out:
                z = ZipWriter(out, zip64)
                z.add_parts(ARCHIVE, parts, held, crc)
                z.add(INDEX, ("\n".join(lines) + "\n").encode())
                z.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE, "bytes": held}]}).encode())
                z.close()
                size = z.at
            fs.move(f"{root}/.{name}.part", f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])
            parts, lines, held = [], [], 0
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                for page, url, html, digest, refers in zip(*(c.slice(i, 100).to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    raw = write_record("" if page is None else str(page), url, digest, payload, None if refers is None else str(refers))
                    lines.append(json.dumps({"url": url, "digest": digest, "offset": held, "length": len(raw), "filename": ARCHIVE}))
                    parts.append(raw)
                    held += len(raw)
                    if held >= package_bytes:
                        yield flush()
        if lines:
            yield flush()

    return records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n_records bigint, n_bytes bigint")


def _reader(path: str):
    fs, name = open_path(path)
    f = fs.open_input_file(name)
    return f, ZipReader(lambda at, n: f.read_at(n, at), f.size())


def locate(packages: DataFrame) -> DataFrame:
    """``path`` of packages -> path, at, n for each record, from their directories and indexes (no record is read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                f, z = _reader(path)
                with f:
                    archives = {m.name: m for m in z.stored("archive/")}
                    for index in z.stored("indexes/", ".cdxj"):
                        rows = [json.loads(x) for x in z.read(index).decode().splitlines() if x]
                        at = [archives[r["filename"]].at + r["offset"] for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], ["path", "at", "n"])

    return packages.select("path").mapInArrow(run, "path string, at bigint, n bigint")


def read(located: DataFrame, payloads: bool = False) -> DataFrame:
    """path, at, n -> page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload, if asked for).

    Neighbouring records are fetched by one range request; only the ranges asked for are read.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def fetched(rows: list[tuple[str, int, int]]) -> Iterator[Record]:
        rows.sort()
        i = 0
        while i < len(rows):
            path, start, n = rows[i]
            f, end, j = *(open_path(path)), i
            f = f.open_input_file(end)
            with f:
                while i < len(rows) and rows[i][0] == path:
                    start, end = rows[i][1], rows[i][1] + rows[i][2]
                    j = i + 1
                    while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - start <= SPAN:
                        end = max(end, rows[j][1] + rows[j][2])
                        j += 1
                    data = f.read_at(end - start, start)
                    for _, at, n in rows[i:j]:
                        yield parse_record(data[at - start : at - start + n])
                    i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                got = [(int(r.key) if r.key else None, r.url, r.kind, r.payload_bytes, r.digest, int(r.refers_to) if r.refers_to else None, r.payload) for r in fetched(list(zip(*(c.slice(i, 1000).to_pylist() for c in batch.columns), strict=True)))]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), kinds, strict=False)], names)

    return located.select("path", "at", "n").mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` and read the packages back. Empty tables give empty results."""
    spark = pages.sparkSession
    import uuid

    folder = folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    packages = cut(write(plan(pages), folder), "packages")
    # Packages are few and records many, so what is located is dealt out anew, by position.
    n = max(1, spark.sparkContext.defaultParallelism * 2)
    where = locate(packages.repartition(n, "path")).repartition(n, "path", (F.col("at") / F.lit(4 * 1024 * 1024)).cast("long"))
    return read(where)


def digest_of(text: Column) -> Column:
    """SHA-1 in bare lower-case hex of a text's UTF-8, null as empty."""
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))
