"""WARC archives as a Spark data source, written and read.

    spark.read.format("warc").load(folder)                      # whole records
    spark.read.format("warc").option("payload", "false")...     # headers only
    df.write.format("warc").mode("append").save(folder)
    df.write.format("warc").option("compression", "none")...    # plain archives

Archives are compressed record by record, a gzip member each, unless told otherwise; both kinds are
read. Members carry their compressed length in the extra field "sl", so that a record whose payload
is not wanted is passed over without inflating it; members without it, or with several records, are
inflated to their end.

Reading: files are planned into partitions by size. Filters on record_type, target_uri, record_id,
payload_digest and refers_to are pushed down. Of each record the headers are parsed first; a record
that fails a filter, or whose payload is not asked for, is passed over by its length.

Writing: every task writes files of its own under a hidden folder; a commit moves the files of the
tasks that succeeded into place, so lost executors leave nothing behind.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from adlytics.workspace import Workspace

VERSION = b"WARC/1.1\r\n"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of archives read by one task, and size from which a writer begins a new file.
PARTITION_BYTES = 16 << 20
FILE_BYTES = 64 << 20
#: Payload bytes handed to Spark at a time.
BATCH_BYTES = 8 << 20
#: Compressed bytes taken at a time.
INFLATE_BYTES = 16 << 10
COMPRESSION_LEVEL = 1
_DATE = "1970-01-01T00:00:00Z"
_SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_length long, refers_to string, content_type string, payload binary"
)
_ARROW = pa.schema(
    [
        *((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "payload_digest")),
        ("payload_length", pa.int64()),
        ("refers_to", pa.string()),
        ("content_type", pa.string()),
        ("payload", pa.binary()),
    ]
)
#: Column by header name.
_HEADERS = {
    "warc-record-id": "record_id",
    "warc-type": "record_type",
    "warc-target-uri": "target_uri",
    "warc-date": "date",
    "warc-payload-digest": "payload_digest",
    "x-payload-length": "payload_length",
    "warc-refers-to": "refers_to",
    "content-type": "content_type",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32."""
    return base32(F.sha1(payload))


def base32(digits: Column) -> Column:
    """40 hexadecimal digits in base 32, by parts of 20 bits: five of them make four characters."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            parts.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*parts)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- reading ----------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Archives that one task reads."""

    paths: Sequence[str]

    def __init__(self, paths: Sequence[str]):
        super().__init__(tuple(paths))
        self.paths = tuple(paths)


def parse_headers(stream: io.BufferedReader) -> dict[str, str] | None:
    """Header fields of the next record, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record here: {line[:40]!r}")
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:  # a field continued on the next line
            found[name] += " " + line.decode("utf-8", "replace").strip()
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Member(io.RawIOBase):
    """One gzip member of a file, inflated as it is read; `length` is its length where the extra field tells it."""

    def __init__(self, stream: io.BufferedReader):
        self.stream, self.start, self.length = stream, stream.tell(), 0
        magic, flags = struct.unpack("<3sB6x", stream.read(10))
        if magic != b"\x1f\x8b\x08":
            raise ValueError("no gzip member here")
        extra = stream.read(int.from_bytes(stream.read(2), "little")) if flags & 4 else b""
        while len(extra) >= 4:
            size = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"sl" and size == 8:
                self.length = int.from_bytes(extra[4:8], "little")
            extra = extra[4 + size :]
        for bit in (8, 16):  # a name, a comment
            while flags & bit and stream.read(1) not in (b"\0", b""):
                pass
        stream.read(2 if flags & 2 else 0)
        self.machine = zlib.decompressobj(-zlib.MAX_WBITS)
        self.held = b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.machine.eof:
            raw = self.held or self.stream.read(INFLATE_BYTES)
            if not raw:
                raise ValueError("a gzip member is cut off")
            found = self.machine.decompress(raw, len(buffer))
            self.held = self.machine.unconsumed_tail
            if found:
                buffer[: len(found)] = found
                return len(found)
        return 0

    def leave(self) -> None:
        """Go on to the next member."""
        if self.length:
            self.stream.seek(self.start + self.length)
            return
        while self.read(1 << 16):
            pass
        self.stream.seek(8 - len(self.machine.unused_data), io.SEEK_CUR)


def read_members(stream: io.BufferedReader, wanted, payload: bool) -> Iterator[dict]:
    """Records of a compressed archive."""
    while stream.peek(1):
        member = Member(stream)
        yield from read_records(io.BufferedReader(member, INFLATE_BYTES), wanted, payload, alone=member.length > 0)
        member.leave()


def _skip(stream: io.BufferedReader, length: int) -> None:
    if stream.seekable():
        stream.seek(length, io.SEEK_CUR)
        return
    while length > 0 and (read := len(stream.read(min(length, 1 << 16)))):
        length -= read


def read_records(stream: io.BufferedReader, wanted, payload: bool, alone: bool = False) -> Iterator[dict]:
    """Records whose columns pass `wanted`. Blocks of the others are skipped unread; nothing follows one that is alone."""
    while (headers := parse_headers(stream)) is not None:
        length = int(headers.get("content-length", "0"))
        row: dict = dict.fromkeys(_ARROW.names)
        for name, column in _HEADERS.items():
            row[column] = headers.get(name)
        for column in ("record_id", "refers_to"):
            row[column] = row[column].strip("<>") if row[column] else None
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        if not wanted(row):
            if alone:
                return
            _skip(stream, length)
            continue
        if payload:
            block = stream.read(length)
            if len(block) < length:
                raise ValueError(f"record {row['record_id']} is cut off")
            http = (row["content_type"] or "").startswith("application/http")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
        elif not alone:
            _skip(stream, length)
        yield row
        if alone:
            return


def _passes(kind: str, column: str, value):
    if kind == "in":
        return lambda row: row[column] in value
    if kind == "prefix":
        return lambda row: row[column] is not None and row[column].startswith(value)
    if kind == "present":
        return lambda row: row[column] is not None
    return lambda row: row[column] == value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):
        """Take over what headers alone decide; Spark applies the rest."""
        simple = set(_ARROW.names) - {"payload", "payload_length"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in simple:
                yield f
            elif isinstance(f, EqualTo) or (isinstance(f, EqualNullSafe) and f.value is not None):
                self.tests.append(("equal", name, f.value))
            elif isinstance(f, In):
                self.tests.append(("in", name, frozenset(v for v in f.value if v is not None)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("prefix", name, f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append(("present", name, None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        planned, size = [[]], 0
        for path, length in files:
            if planned[-1] and size + length > self.most:
                planned.append([])
                size = 0
            planned[-1].append(path)
            size += length
        return [Files(p) for p in planned]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        tests = [_passes(*t) for t in self.tests]
        held, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file, io.BufferedReader(file, 1 << 20) as stream:
                read = read_members if path.endswith(".gz") else read_records
                for row in read(stream, lambda row: all(t(row) for t in tests), self.payload):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


# --- writing ----------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def record(row) -> bytes:
    """One record. Responses hold an HTTP head and the payload, revisits no block."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = b"" if revisit else head + payload
    uri = row["target_uri"]
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row["date"] or _DATE,
        "WARC-Target-URI": uri and quote(uri, safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": row["payload_digest"],
        "X-Payload-Length": row["payload_length"],
        "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>",
        "WARC-Profile": _REVISIT if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that tells its own length, where 32 bits hold it, and that of its content."""
    machine = zlib.compressobj(COMPRESSION_LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = machine.compress(raw) + machine.flush()
    ending = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    length = 10 + 2 + 12 + len(body) + len(ending)
    if max(length, len(raw)) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + ending
    told = b"sl" + struct.pack("<HII", 8, length, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(told)) + told + body + ending


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.compression = options.get("compression", "gzip").lower()
        if self.compression not in ("gzip", "none"):
            raise ValueError(f"no such compression: {self.compression}")
        self.job = uuid.uuid4().hex
        if overwrite:
            raise ValueError("archives are only added to: use mode append and a new folder")

    def _hidden(self, root: str) -> str:
        return posixpath.join(root, f".writing-{self.job}")

    def write(self, rows: Iterator) -> Written:
        system, root = _place(self.path)
        system.create_dir(self._hidden(root), recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for row in rows:
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc" + (".gz" if self.compression == "gzip" else "")
                    out, size = system.open_output_stream(posixpath.join(self._hidden(root), name), compression=None), 0
                    files.append(name)
                found = member(record(row)) if self.compression == "gzip" else record(row)
                out.write(found)
                size += len(found)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                system.move(posixpath.join(self._hidden(root), name), posixpath.join(root, name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, root = _place(self.path)
        hidden = self._hidden(root)
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format "warc" known to the session, with filters pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")


def records(pages: DataFrame, space: Workspace | None = None) -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads the smallest page_id is the response.

    The others revisit it and carry no payload. A null html is an empty payload, a null url leaves
    the field out. Rows that repeat the smallest page_id of a payload are all responses; a null
    page_id comes last and has the record id urn:page: alone. With a workspace the digests are saved,
    so that payloads are read twice instead of three times.
    """
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("sha", F.sha1("payload"))
    narrow = named.select("page_id", "sha")
    narrow = space.save(narrow, "digests") if space else narrow
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"))
    # Copies of one payload are many, pages are not: decide on narrow rows, then join by page.
    decided = narrow.distinct().join(firsts, "sha")
    decided = decided.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "first")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha"))
    joined = named.join(decided, same)
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(revisit, urn("first")).alias("refers_to"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    number = F.substring(F.col(urn), len("urn:page:") + 1, F.lit(20))
    return F.when(number != "", number).cast("long")
