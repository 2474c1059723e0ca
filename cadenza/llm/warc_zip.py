r"""WARC records in ZIP packages: written with an index, read back by range reads, without extraction.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, a run of WARC/1.1 records of one gzip member
each, and ``indexes/index.cdxj``, one line per record with its place in the first. Packages are ZIP64 throughout, and a
new one is begun at `ROLL_BYTES`, so that an index fits in memory.

The reader finds the end record and, where there is one, the ZIP64 end record, parses the central directory, takes members
that are stored, reads the index and then ranges of records only, `READ_BYTES` at a time. A compressed member, a
wrong signature or a record whose payload does not match its digest is an error (`ZipError`, `WarcError`).

Records with equal payloads of at least `least` bytes: the one with the smallest page_id is a response, the others are
revisits of it; smaller payloads are all responses. Equality is by SHA-1 and length.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs), in the shared folder. A task writes under a name of its
own and moves the file when it is whole, so a task that is run again leaves one whole package.

Defined cases: null html is an empty payload; a null url is an empty target; a null page_id is never referred to (records of
which no equal one has an id are responses); rows with equal ids and payloads are all responses if theirs is the smallest;
no rows write no package and give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROLL_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 20, 1
DATE = "2026-01-01T00:00:00Z"
URN = "urn:cadenza:page:"
_LOCAL, _CENTRAL, _END, _END64, _FIND64, _DATA = (struct.pack("<I", x) for x in (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50))
_FULL = 0xFFFFFFFF


class ZipError(ValueError):
    pass


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class StoredZip:
    """Writes stored members to a stream that cannot seek: sizes follow in data descriptors and stand in the directory."""

    def __init__(self, stream):
        self.stream, self.at, self.done = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.start, self.crc, self.size = raw, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, _FULL, _FULL, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(_DATA + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.done.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.done:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, _FULL, _FULL, len(raw), len(extra), 0, 0, 0, 0, _FULL) + raw + extra)
        size, n, at = self.at - start, len(self.done), self.at
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(_FIND64 + struct.pack("<IQI", 0, at, 1))
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), _FULL, _FULL, 0))


class Ranges:
    """Range reads of a file, through a window of READ_BYTES."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ZipError(f"bytes {at} to {at + n} of {self.size}")
        if not self.at <= at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, READ_BYTES), self.size - at))
        return self.held[at - self.at : at - self.at + n]


def directory(ranges: Ranges) -> dict[str, tuple[int, int]]:
    """(offset of the data, size) by name, of the stored members."""
    tail = min(ranges.size, 22 + 0xFFFF)
    end = ranges.read(ranges.size - tail, tail)
    k = end.rfind(_END)
    while k >= 0 and k + 22 + int.from_bytes(end[k + 20 : k + 22], "little") != len(end):  # the mark can also stand in a comment
        k = end.rfind(_END, 0, k)
    if k < 0:
        raise ZipError("no end record")
    n, size, start = struct.unpack("<10xHII2x", end[k : k + 22])
    at = ranges.size - tail + k
    if at >= 20 and ranges.read(at - 20, 4) == _FIND64:
        (where,) = struct.unpack("<8xQ4x", ranges.read(at - 20, 20))
        record = ranges.read(where, 56)
        if record[:4] != _END64:
            raise ZipError("no ZIP64 end record where the locator points")
        n, size, start = struct.unpack("<32xQQQ", record)
    table, at, found = ranges.read(start, size), 0, {}
    for _ in range(n):
        if table[at : at + 4] != _CENTRAL:
            raise ZipError("not a directory entry")
        flags, method, packed, plain, name_n, extra_n, comment_n, offset = struct.unpack("<8xHH8xIIHHH8xI", table[at : at + 46])
        name = table[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = table[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: of these, in this order, the ones that are full in the entry
                values = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain = next(values) if plain == _FULL else plain
                packed = next(values) if packed == _FULL else packed
                offset = next(values) if offset == _FULL else offset
            extra = extra[4 + length :]
        at += 46 + name_n + extra_n + comment_n
        if method == 0 and not flags & 1:
            found[name] = (offset, packed)
    out = {}
    for name, (offset, packed) in found.items():
        head = ranges.read(offset, 30)
        if head[:4] != _LOCAL:
            raise ZipError(f"no local header of {name}")
        out[name] = (offset + 30 + sum(struct.unpack("<26xHH", head)), packed)
    return out


def record(page_id: int | None, url: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A WARC record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    safe = url.encode("utf-8", "surrogatepass").decode("latin-1").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """page_id, url, payload (None of a revisit), payload_bytes, payload_digest, record_type, refers_to of a record."""
    z = zlib.decompressobj(31)
    data = z.decompress(raw) + z.flush()
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    if not first.startswith("WARC/"):
        raise WarcError("not a WARC record")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(field["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise WarcError("a block of another length than the header has")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len(URN) + 1 : -1]) if x and x != f"<{URN}>" else None
    kind, want = field["warc-type"], field["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or digest(payload) != want):
        raise WarcError("a payload that does not match its digest")
    return {
        "page_id": number(field["warc-record-id"]), "url": field["warc-target-uri"].encode("latin-1").decode("utf-8", "replace"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": want, "record_type": kind, "refers_to": number(field.get("warc-refers-to")),
    }


class Package:
    """A package while it is written."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path, self.uri = f"{root}/{name}", f"{folder}/{name}"
        self.own = f"{root}/.{name}-{uuid.uuid4().hex}"
        self.fs.create_dir(root)
        self.stream = self.fs.open_output_stream(self.own, compression=None)
        self.zip, self.index, self.bytes = StoredZip(self.stream), [], 0
        self.zip.begin(DATA)

    def add(self, raw: bytes, **line) -> None:
        self.index.append(json.dumps(line | {"offset": self.zip.size, "length": len(raw)}))
        self.zip.write(raw)

    def close(self) -> tuple[str, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.write("".join(f"{x}\n" for x in self.index).encode())
        self.zip.end()
        self.zip.close()
        self.stream.close()
        self.fs.move(self.own, self.path)
        return self.uri, len(self.index)


def _missing(x) -> bool:
    return x is None or x != x or x is pd.NA


def write_packages(pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row of pages to packages in folder (a URI that driver and executors share); returns (path, n_records), written."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    same = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.count("*").alias("times"), F.min("page_id").alias("first")).where("times > 1 and first is not null")
    same = small(written(same.select(F.col("sha").alias("sha_"), F.col("n").alias("n_"), "first"), "warc-same"))
    rows = rows.join(same, (F.col("sha") == F.col("sha_")) & (F.col("n") == F.col("n_")), "left")
    rows = rows.select("page_id", "url", "payload", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, package, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for i, u, p, sha, r in zip(b.page_id, b.url, b.payload, b.sha, b.refers_to, strict=True):
                if package is None:
                    package = Package(folder, f"part-{part:06d}-{number:04d}.zip")
                    number += 1
                i, r = None if _missing(i) else int(i), None if _missing(r) else int(r)
                d = base64.b32encode(bytes.fromhex(sha)).decode()
                package.add(record(i, u, bytes(p), d, r), url=u, digest=f"sha1:{d}", mime="warc/revisit" if r is not None else "text/html", filename=DATA)
                if package.zip.at >= ROLL_BYTES:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "n_records"])

    return written(rows.mapInPandas(write, "path string, n_records long"), "warc-packages")


def records_of(path: str) -> Iterator[dict]:
    """Records of one package, in the order of its index."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        ranges = Ranges(file)
        members = directory(ranges)
        if INDEX not in members:
            raise ZipError(f"no stored index in {os.path.basename(path)}")
        lines = ranges.read(*members[INDEX]).decode().splitlines()
        for line in map(json.loads, lines):
            start, size = members[line["filename"]]
            if line["offset"] + line["length"] > size:
                raise ZipError("an index line beyond its member")
            yield parse(ranges.read(start + line["offset"], line["length"]))


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, payload: bool = False, rows: int = 500) -> DataFrame:
    """Records of the packages listed in column path; with payload, a binary column payload (null of revisits)."""
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for b in batches:
            for path in b.path:
                for r in records_of(path):
                    held.append({k: r[k] for k in names})
                    if len(held) >= rows:
                        yield _frame(held, names)
                        held = []
        if held:
            yield _frame(held, names)

    n = max(packages.count(), 1)
    return packages.select("path").repartitionByRange(n, "path").mapInPandas(read, FIELDS + ", payload binary" * payload)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def new_folder(spark: SparkSession, label: str = "warc") -> str:
    """A new folder below the shared one, as a full URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().replace("file:/", "file:///").replace("file://///", "file:///")
