"""WARC records in ZIP packages, written and read back by ranges.

Each task writes one package or more: a stored member with the WARC records, each compressed by itself so that it can be read
by itself, and a stored member with an index line per record. Reading never unpacks: the end of the file gives the central directory (through its ZIP64 records if the
package needs them), the directory gives the place of the index, the index gives the place of every record, and records
are read by range. Ranges of neighbouring records are joined up to ``range_bytes`` and dealt over all tasks.

Equal payloads are stored once: the record of the smallest page is a response, the others are revisits that name it.

Files go to a shared folder through Arrow's file systems, under a name no other attempt uses. Only packages named in the
stored manifest count, so what a lost executor left half written is never read.

Defined results: a null payload counts as empty; a null URL is left out; control characters in a URL are escaped. Among equal
payloads the smallest id is the response, a null id only if there is no other; where rows repeat both id and payload, one is the response and
the others revisit it. An empty table gives an empty manifest and no rows. Extra columns are not stored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import stored

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "archive string, records bigint, bytes bigint"
ENTRIES = "archive string, start bigint, length bigint, sizes array<bigint>"
PAGES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
U32, U16 = 0xFFFFFFFF, 0xFFFF


# ---- ZIP ---------------------------------------------------------------------------------------------------------

class Package:
    """Writes stored members one after the other to a stream that cannot seek."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> int:
        """Start a member; its size and checksum follow in a data descriptor. Returns where its content begins."""
        self.name, self.header, self.crc = name.encode(), self.at, 0
        self.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)
        self.begin = self.at
        return self.begin

    def add(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.write(data)

    def close(self) -> None:
        size = self.at - self.begin
        wide = self.zip64 or size >= U32
        self.write(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.header))

    def finish(self) -> None:
        start = self.at
        for name, crc, size, header in self.members:
            extra = b""
            if self.zip64 or size >= U32:
                extra += struct.pack("<QQ", size, size)
            if self.zip64 or header >= U32:
                extra += struct.pack("<Q", header)
            if extra:
                extra = struct.pack("<HH", 1, len(extra)) + extra
            small = U32 if self.zip64 or size >= U32 else size
            place = U32 if self.zip64 or header >= U32 else header
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, small, small, len(name),
                                   len(extra), 0, 0, 0, 0, place) + name + extra)
        size, count = self.at - start, len(self.members)
        if self.zip64 or start >= U32:
            end64 = self.at
            self.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self.write(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            start = U32
        self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0))


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"the file ends before byte {start + length}")
    return data


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package by name: (method, header's place, stored size), from the central directory alone."""
    tail_at = max(0, size - 22 - U16)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if U32 in (length, start) or count == U16:
        locator = read_range(f, tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = read_range(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    data, at, members = read_range(f, start, length), 0, {}
    for _ in range(count):
        if data[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, full, n, x, c = struct.unpack_from("<IIHHH", data, at + 20)
        place, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + n].decode()
        extra, end = at + 46 + n, at + 46 + n + x
        while extra + 4 <= end:
            kind, width = struct.unpack_from("<HH", data, extra)
            if kind == 1:  # the wide fields that the narrow ones point to, in this order
                wide = extra + 4
                if full == U32:
                    full, = struct.unpack_from("<Q", data, wide)
                    wide += 8
                if packed == U32:
                    packed, = struct.unpack_from("<Q", data, wide)
                    wide += 8
                if place == U32:
                    place, = struct.unpack_from("<Q", data, wide)
            extra += 4 + width
        members[name] = (method, place, packed)
        at = end + c
    return members


def content(f, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's content lies: (start, length)."""
    method, place, size = member
    if method != 0:
        raise ValueError("the member is compressed: its records have no ranges")
    header = read_range(f, place, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no member at this place")
    n, x = struct.unpack_from("<HH", header, 26)
    return place + 30 + n + x, size


# ---- WARC --------------------------------------------------------------------------------------------------------

def warc_record(page_id, row: int, url, payload: bytes, digest: str, refers_to, first_row, date: str) -> bytes:
    """One response record, or a revisit record if the page repeats another one's payload. The HTTP headers of either give the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first_row is not None
    block = http if revisit else http + payload
    name = lambda p, r: f"<urn:page:{'' if p is None else p}:{r}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, row)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, first_row)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without end of headers")
    lines = data[:end].decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def parse_record(data: bytes) -> tuple:
    """A row of PAGES from the bytes of one record; a response's payload is checked against its digest."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("no WARC record at this place")
    head, at = _headers(data)
    block = data[at:at + int(head["content-length"])]
    http, body = _headers(block)
    page = lambda v: int(v.split(":")[2]) if v.split(":")[2] else None
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    payload = None
    if head["warc-type"] == "response":
        payload = block[body:]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"record {head['warc-record-id']} is damaged")
    refers = page(head["warc-refers-to"]) if head["warc-type"] == "revisit" else None
    return page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], refers, payload


# ---- Spark -------------------------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   package_bytes: int = 1 << 30, zip64: bool = False, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the packages below ``folder`` (a URI that executors reach) and return the stored manifest."""
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row")
                        ).withColumn("sha1", F.sha1("payload"))
    rows = stored(rows, "records")  # the numbers hold once stored, whatever the input is; the grouping below reads narrow columns only
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = (rows.groupBy("sha1").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("sha1"), F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))
    repeats = F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    marked = rows.join(first, "sha1", "left").select(
        "page_id", "row", "url", "payload", "sha1", F.when(repeats, F.col("first_page")).alias("refers_to"),
        F.when(repeats, F.col("first_row")).alias("first_row"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        fs, root = pafs.FileSystem.from_uri(folder)

        def close():
            package.close()
            package.open(INDEX)
            package.add(b"".join(index))
            package.close()
            package.finish()
            package.out.close()
            done.append((f"{folder}/{name}", len(index), package.at))

        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            for r in part.to_pylist():
                if package is None:
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    fs.create_dir(root, recursive=True)
                    package = Package(fs.open_output_stream(f"{root}/{name}"), zip64)
                    package.open(RECORDS)
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                record = gzip.compress(warc_record(r["page_id"], r["row"], r["url"], r["payload"], digest, r["refers_to"], r["first_row"], date), 1, mtime=0)
                line = {"url": r["url"], "digest": digest, "offset": package.at - package.begin, "length": len(record), "filename": RECORDS}
                index.append(f"- 20240101000000 {json.dumps(line)}\n".encode())
                package.add(record)
                if package.at >= package_bytes:
                    close()
                    package = None
        if package is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], names=["archive", "records", "bytes"])

    return stored(marked.mapInArrow(write, MANIFEST), "manifest")


def _open(archive: str):
    fs, path = pafs.FileSystem.from_uri(archive)
    return fs.open_input_file(path)


def index_ranges(manifest: DataFrame, range_bytes: int = 1 << 22) -> DataFrame:
    """Ranges of neighbouring records in every package, read from its directory and index."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with _open(archive) as f:
                    members = directory(f, f.size())
                    base, _ = content(f, members[RECORDS])
                    lines = read_range(f, *content(f, members[INDEX])).splitlines()
                out, start, sizes = [], None, []
                for line in lines:
                    entry = json.loads(line.split(b" ", 2)[2])
                    at, length = base + entry["offset"], entry["length"]
                    if sizes and (at != start + sum_ or sum_ + length > range_bytes):
                        out.append((archive, start, sum_, sizes))
                        sizes = []
                    if not sizes:
                        start, sum_ = at, 0
                    sizes.append(length)
                    sum_ += length
                if sizes:
                    out.append((archive, start, sum_, sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                    names=["archive", "start", "length", "sizes"])

    archives = manifest.count()
    return manifest.repartition(_tasks(manifest, archives, -(-archives // 64)), "archive").select("archive").mapInArrow(ranges, ENTRIES)


def _tasks(df: DataFrame, units: int, least: int) -> int:
    """Enough tasks for all cores and for the bytes, but no more than there are units of work."""
    return max(1, min(units, max(least, df.sparkSession.sparkContext.defaultParallelism)))


def read_archives(manifest: DataFrame, payloads: bool = True, range_bytes: int = 1 << 22, task_bytes: int = 1 << 28) -> DataFrame:
    """The pages that the packages hold, in the columns of PAGES. Without ``payloads`` that column stays null."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["archive"]) as f:
                    data = read_range(f, r["start"], r["length"])
                rows, at = [], 0
                for size in r["sizes"]:
                    row = parse_record(gzip.decompress(data[at:at + size]))
                    rows.append(row if payloads else (*row[:6], None))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], schema.field(i).type) for i in range(7)], schema=schema)

    # The list of ranges is tiny beside what it stands for: the number of tasks follows the packages' bytes.
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = _tasks(manifest, -(-size // range_bytes), -(-size // task_bytes))
    return index_ranges(manifest, range_bytes).repartition(tasks, "archive", "start").mapInArrow(records, PAGES)
