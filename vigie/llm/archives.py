"""Web archives packaged in ZIP files: written, then read record by record without unpacking.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj``, both stored without compression, so a record is one range of the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from vigie.session import fresh_folder, stored

PACKAGE_BYTES = 128 << 20
# Tasks that read packages, at most.
READERS = 10_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# --- fixed values of the formats ----------------------------------------------
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {digest}')}>"


def _line(value: str | None) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: the whole payload behind an HTTP head, or for a revisit the head alone."""
    digest = digest_of(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


class PackageWriter:
    """One package, written front to back; only the index lines are held."""

    def __init__(self, sink):
        self.zip, self.lines, self.size = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), [], 0
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, content: bytes, url: str | None) -> None:
        packed = gzip.compress(content, 6, mtime=0)
        self.lines.append(json.dumps({"url": url, "offset": self.size, "length": len(packed)}))
        self.data.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()


@dataclass(frozen=True)
class Member:
    method: int
    packed: int
    size: int
    header: int


class PackageReader:
    """Members of a ZIP file by ranges: the end record, the directory, then only what is asked for."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError(f"{n} bytes at {at} are beyond the end")
        return data

    def _directory(self) -> dict[str, Member]:
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and tail_at + at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != self.size:
            at = tail.rfind(END, 0, at)  # the signature inside a comment
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        n, size, start = struct.unpack("<HII", tail[at + 10:at + 20])
        end = tail_at + at
        if (n == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20:
            locator = self.read(end - 20, 20)
            if locator[:4] == LOCATOR:
                there = struct.unpack("<Q", locator[8:16])[0]
                wide = self.read(there, 56)
                if wide[:4] != END64:
                    raise ValueError("the ZIP64 end record is not where its locator says")
                n, size, start = struct.unpack("<QQQ", wide[32:56])
        return self._entries(self.read(start, size), n)

    @staticmethod
    def _entries(directory: bytes, n: int) -> dict[str, Member]:
        members, at = {}, 0
        for _ in range(n):
            if directory[at:at + 4] != ENTRY:
                raise ValueError("a broken ZIP directory")
            flags, method = struct.unpack("<HH", directory[at + 8:at + 12])
            packed, size, name_n, extra_n, note_n = struct.unpack("<IIHHH", directory[at + 20:at + 34])
            header = struct.unpack("<I", directory[at + 42:at + 46])[0]
            name = directory[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, i = directory[at + 46 + name_n:at + 46 + name_n + extra_n], 0
            while i + 4 <= len(extra):
                kind, length = struct.unpack("<HH", extra[i:i + 4])
                if kind == 1:  # the wide values, only for the fields that are full
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[i + 4:i + 4 + length // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                i += 4 + length
            members[name] = Member(method, packed, size, header)
            at += 46 + name_n + extra_n + note_n
        return members

    def start(self, member: Member) -> int:
        """Where a member's bytes begin: its local header has lengths of its own."""
        local = self.read(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError("no local header where the directory says")
        return member.header + 30 + sum(struct.unpack("<HH", local[26:30]))

    def whole(self, name: str) -> bytes:
        member = self.members[name]
        data = self.read(self.start(member), member.packed)
        return zlib.decompress(data, -15) if member.method == 8 else data

    def records(self) -> Iterator[bytes]:
        """Each record by its range, found through the index."""
        member = self.members[DATA]
        if member.method:
            raise ValueError("the archive is not stored as it is")
        base = self.start(member)
        for line in self.whole(INDEX).decode().splitlines():
            place = json.loads(line)
            yield gzip.decompress(self.read(base + place["offset"], place["length"]))


def decide(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``_revisit`` and ``_refers_to``: of equal payloads the largest key stays, others revisit it.

    Payloads below ``min_bytes`` are all responses; rows that share the largest key are, too. Null
    keys revisit a record that has one; if none has, they are responses.
    """
    bytes_ = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    marked = pages.withColumn("_digest", F.sha1(bytes_)).withColumn("_size", F.octet_length(bytes_))
    groups = (
        marked.filter(F.col("_size") >= min_bytes)
        .groupBy(F.col("_digest").alias("_group"))
        .agg(F.max(key).alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1 and _last is not null")
    )
    joined = marked.join(groups, F.col("_digest") == F.col("_group"), "left")
    revisit = F.col("_last").isNotNull() & ~F.col(key).eqNullSafe(F.col("_last")) & (F.col("_size") >= min_bytes)
    return joined.withColumn("_revisit", revisit).withColumn("_refers_to", F.when(revisit, F.col("_last"))).drop(
        "_digest", "_size", "_group", "_last", "_n")


def write_packages(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes one record per row into packages in a shared folder; returns ``path``, ``records``, ``bytes``.

    A task writes its rows front to back into packages of about ``package_bytes`` and holds one
    record at a time. Names are new for each attempt, and only those of attempts that ended well
    are returned, so a lost executor leaves files that nobody reads.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        writer = sink = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            writer.close()
            sink.close()
            done.append((path, len(writer.lines), writer.size))

        for batch in batches:
            for page_id, address, text, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    sink = files.open_output_stream(path)
                    writer = PackageWriter(sink)
                writer.add(record(page_id, address, (text or "").encode("utf-8", "surrogatepass"), refers_to, revisit, date), address)
                if writer.size >= package_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([p for p, _, _ in done], pa.string()),
                "records": pa.array([n for _, n, _ in done], pa.int64()), "bytes": pa.array([b for _, _, b in done], pa.int64()),
            })

    rows = decide(pages.select(F.col(key).cast("long").alias(key), url, payload), key, payload, min_bytes)
    return stored(
        rows.select(key, url, payload, "_revisit", "_refers_to").mapInArrow(write, "path string, records long, bytes long"),
        "packages",
    )


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_packages(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the named packages; ``payload`` is null for revisits, and without ``payloads``.

    One package is one row of work. Length and digest of a response are those of the bytes read; a
    digest that differs from the header's is an error. A revisit's are in its headers.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                rows: list[tuple] = []
                with files.open_input_file(path) as source:
                    for data in PackageReader(source, source.size()).records():
                        rows.append(_row(data, payloads))
                        if len(rows) == 2000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    # A number of tasks that adaptive execution keeps; by the path alone it would merge these few rows.
    tasks = max(1, min(packages.count(), READERS))
    return packages.select("path").repartition(tasks, "path").mapInPandas(read, READ)


def _row(data: bytes, payloads: bool) -> tuple:
    headers, block = parse_record(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if revisit:
        size = next(int(line[16:]) for line in head.decode().split("\r\n") if line.startswith("Content-Length: "))
    else:
        size = len(payload)
        if digest_of(payload) != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
    text = payload.decode("utf-8", "surrogatepass") if payloads and not revisit else None
    return (int(page) if page else None, headers["warc-target-uri"], size, digest, headers["warc-type"],
            int(refers) if refers else None, text)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split(" ")[0] for part in READ.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def roundtrip(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    payloads: bool = True,
) -> DataFrame:
    """Writes ``pages`` to packages in the shared folder and reads every record back.

    Null payloads are empty; a null address comes back empty. Extra columns are not archived;
    repeated rows are records of their own; no rows give no packages and no records.
    """
    folder = fresh_folder(pages.sparkSession, "archives")
    return read_packages(write_packages(pages, folder, key, url, payload, min_bytes), folder, payloads)
