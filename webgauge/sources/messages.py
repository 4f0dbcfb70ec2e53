"""Captured HTTP messages in archive files (WARC records of type response), as a Spark data source.

``spark.read.format("http_messages").load(folder)`` cuts files into byte ranges; a record belongs to the range that it
begins in.  A range's first record is found by its border, and is believed only if the records after it follow each other
without a gap to the end of the range and ``RECORD_LIMIT`` bytes on, so that an archive captured within a body is not
taken for records.  Bodies come as they were sent, freed from chunks and cut at a limit.

``df.write.format("http_messages").save(folder)`` writes (url, fetched_at, status, status_message, http_version,
raw_headers, body): each task a file of its own, which appears under its name when the whole job has succeeded.

Paths are those that pyarrow's file systems open: local or mounted folders, file, hdfs, s3 and gs addresses.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from webgauge.constants import MAX_BODY_BYTES
from webgauge.functions import urls
from webgauge.runtime import ship
from webgauge.sources.captures import decode_body, inflate

NAME = "http_messages"
COLUMNS = """url string, fetched_at timestamp, status int, status_message string, http_version string, headers map<string,string>,
    raw_headers array<struct<name:string,value:string>>, location string, content_encoding string, transfer_bytes long, body binary, truncated boolean, error string"""
WRITTEN = "url fetched_at status status_message http_version raw_headers body".split()
SPLIT_BYTES, RECORD_LIMIT, HEAD_LIMIT = 64 << 20, 64 << 20, 256 << 10
#: Bytes whose ranges one task reads, where there are ranges for so many tasks: each range looks at the records of
#: RECORD_LIMIT bytes after it, mostly the same ones as its neighbours.
TASK_BYTES, LEAST_TASKS = 4 << 20, 16
BORDER = b"\r\n\r\nWARC/1."
STATUS_LINE = re.compile(rb"HTTP/(\d(?:\.\d)?) (\d{3})(?: ([^\r\n]*))?\Z")
#: Headers of which the first counts where others of the name are joined by commas.
ONCE = frozenset(
    """age authorization content-length content-type etag expires from host if-modified-since if-unmodified-since last-modified location
    max-forwards proxy-authorization referer retry-after server user-agent""".split()
)


def file_system(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


# -- one message ---------------------------------------------------------------------------------------------------------


def header_lines(head: bytes) -> list[tuple[str, str]]:
    """Names and values in order; a line that begins with white space goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in re.split(rb"\r?\n", head):
        text = line.decode("latin-1")
        if text[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}".strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def header_map(lines: list[tuple[str, str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in lines:
        key = name.lower()
        if key not in out:
            out[key] = value
        elif key not in ONCE:
            out[key] += ("; " if key == "cookie" else ", ") + value
    return out


def unchunk(data: bytes, limit: int) -> tuple[bytes, int, str | None]:
    """(the first ``limit`` bytes, bytes in all, what is wrong) of a body in chunks."""
    parts, kept, total, at = [], 0, 0, 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            return b"".join(parts), total, "chunks end early"
        size = data[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(parts), total, "chunk without a size"
        n, at = int(size, 16), end + 1
        if n == 0:
            return b"".join(parts), total, None
        piece = data[at : at + n]
        total += len(piece)
        if kept < limit:
            parts.append(piece[: limit - kept])
            kept += len(parts[-1])
        if len(piece) < n:
            return b"".join(parts), total, "chunks end early"
        at += n
        at += 2 if data.startswith(b"\r\n", at) else 1


def parse_message(data: bytes, limit: int = MAX_BODY_BYTES) -> dict:
    """The fields of a response; what can't be read is null and named in ``error``."""
    found = re.search(rb"\r?\n\r?\n", data)
    head, body = (data[: found.start()], data[found.end() :]) if found else (data, b"")
    first, _, rest = head.partition(b"\n")
    m = STATUS_LINE.match(first.rstrip(b"\r"))
    lines = header_lines(rest)
    headers = header_map(lines)
    error = None if m else "no status line"
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body, total, wrong = unchunk(body, limit)
        error = error or wrong
    else:
        declared = headers.get("content-length", "")
        if declared.isdigit() and declared.isascii():
            if len(body) < int(declared):
                error = error or "body ends early"
            body = body[: int(declared)]
        total = len(body)
    return {
        "status": int(m[2]) if m else None, "status_message": (m[3] or b"").decode("latin-1") if m else None, "http_version": m[1].decode() if m else None, "headers": list(headers.items()),
        "raw_headers": [{"name": n, "value": v} for n, v in lines], "location": headers.get("location"), "content_encoding": headers.get("content-encoding"), "transfer_bytes": total,
        "body": body[:limit], "truncated": total > limit, "error": error,
    }


def format_message(status: int | None, reason: str | None, version: str | None, lines: list[dict] | None, body: bytes | None) -> bytes:
    """A response; its body is put in chunks of 4,096 bytes where its headers say so."""
    out = [f"HTTP/{version or '1.1'} {status or 200:03d} {reason or ''}".rstrip()]
    clean = lambda s: re.sub(r"[\r\n]+", " ", s or "")
    out += [f"{clean(x['name'])}: {clean(x['value'])}" for x in lines or []]
    body = body or b""
    if any((x["name"] or "").lower() == "transfer-encoding" and "chunked" in (x["value"] or "").lower() for x in lines or []):
        pieces = [body[i : i + 4096] for i in range(0, len(body), 4096)]
        body = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"
    return "\r\n".join([*out, "", ""]).encode("latin-1", "replace") + body


# -- files of records --------------------------------------------------------------------------------------------------


class Records:
    """Records of an archive file by their place in it."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.known: dict[int, int | None] = {}  # what ``after`` said: ranges next to each other look at the same records

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def head(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """(fields, where the content begins, its length) of a record that begins here."""
        for n in (1024, HEAD_LIMIT):
            data = self.read(at, n)
            if not data.startswith(b"WARC/1."):
                return None
            end = data.find(b"\r\n\r\n")
            if end >= 0:
                fields = header_map(header_lines(data[data.find(b"\n") + 1 : end]))
                length = fields.get("content-length", "")
                return (fields, at + end + 4, int(length)) if length.isascii() and length.isdigit() else None
        return None

    def after(self, at: int) -> int | None:
        """Where the next record begins, or the file's end; None if no whole record is here."""
        if at not in self.known:
            self.known[at] = self._after(at)
        return self.known[at]

    def _after(self, at: int) -> int | None:
        head = self.head(at)
        if head is None:
            return None
        end = head[1] + head[2]
        if end + 4 > self.size or self.read(end, 4) != b"\r\n\r\n":
            return None
        return end + 4

    def cut_off(self, at: int) -> bool:
        """Whether the record that begins here goes beyond the file's end."""
        head = self.head(at)
        return head is not None and head[1] + head[2] + 4 > self.size

    def follow(self, at: int, to: int, cut: bool) -> bool:
        """Whether records follow each other from here to a place at least ``to`` or the end; ``cut``: to one cut off."""
        first = at
        while at < min(to, self.size):
            after = self.after(at)
            if after is None:
                return cut and at > first and self.cut_off(at)
            at = after
        return True

    def first_in(self, lo: int, hi: int) -> int | None:
        """The first record that begins in [lo, hi).

        Where no border leads to the file's end whole, one that leads to a record cut off by it will do: a capture that
        broke off loses that record at most.
        """
        if lo == 0:
            return 0 if self.size else None
        found = self._border(lo, hi, False)
        return self._border(lo, hi, True) if found is None else found

    def _border(self, lo: int, hi: int, cut: bool) -> int | None:
        at = max(0, lo - 4)
        while at < hi:
            data = self.read(at, (1 << 20) + len(BORDER))
            k = data.find(BORDER)
            if k < 0:
                if len(data) < (1 << 20) + len(BORDER):
                    return None
                at += 1 << 20
                continue
            start = at + k + 4
            if start >= hi:
                return None
            if self.follow(start, max(hi, start + RECORD_LIMIT), cut):
                return start
            at = start - 3
        return None

    def in_range(self, lo: int, hi: int) -> Iterator[tuple[dict[str, str], bytes]]:
        """(fields, content) of the records that begin in [lo, hi); of long ones the first RECORD_LIMIT bytes."""
        at = self.first_in(lo, hi)
        while at is not None and at < min(hi, self.size):
            head = self.head(at)
            if head is None:
                raise ValueError(f"no record at byte {at}")
            fields, start, length = head
            yield fields, self.read(start, min(length, RECORD_LIMIT))
            after = self.after(at)
            if after is None and not self.cut_off(at):
                raise ValueError(f"no record follows the one at byte {at}")
            at = after


def format_record(url: str, when: datetime.datetime | None, message: bytes) -> bytes:
    stamp = (when or datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    target = re.sub(r"\s+", "%20", url or "")
    fields = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {stamp}\r\nWARC-Target-URI: {target}\r\n"
    fields += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(message)}\r\n\r\n"
    return fields.encode() + message + b"\r\n\r\n"


def _when(text: str | None) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromisoformat((text or "").replace("Z", "+00:00")).astimezone(datetime.timezone.utc)
    except ValueError:
        return None


@dataclass
class Ranges(InputPartition):
    """Byte ranges of a file that one task reads, each by itself."""

    path: str
    bounds: list[tuple[int, int]]
    size: int


class MessageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.max_bytes = int(options.get("maxBytes", MAX_BODY_BYTES))
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, folder = file_system(self.folder)
        info = system.get_file_info(folder)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        ranges = sum(-(-f.size // self.split_bytes) for f in files)
        held = max(1, min(TASK_BYTES // self.split_bytes, ranges // LEAST_TASKS)) * self.split_bytes
        bounds = lambda f, at: [(lo, min(lo + self.split_bytes, f.size)) for lo in range(at, min(at + held, f.size), self.split_bytes)]
        return [Ranges(f.path, bounds(f, at), f.size) for f in files for at in range(0, f.size, held)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        rows, size = [], 0
        with system.open_input_file(partition.path) as file:
            records = Records(file, partition.size)
            for fields, content in (x for lo, hi in partition.bounds for x in records.in_range(lo, hi)):
                if fields.get("warc-type", "").lower() != "response":
                    continue
                row = {"url": fields.get("warc-target-uri"), "fetched_at": _when(fields.get("warc-date")), **parse_message(content, self.max_bytes)}
                rows.append(row)
                size += len(row["body"]) + 1024
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str | None


class MessageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.folder)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc"
        hidden = f"{folder}/.{name}"  # of this attempt alone; a lost executor's is never named by a commit
        empty = True
        with system.open_output_stream(hidden) as out:
            for batch in batches:
                for row in batch.select(WRITTEN).to_pylist():
                    empty = False
                    out.write(format_record(row["url"], row["fetched_at"], format_message(row["status"], row["status_message"], row["http_version"], row["raw_headers"], row["body"])))
        if empty:
            system.delete_file(hidden)
            return Written(None, None)
        return Written(hidden, f"{folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = file_system(self.folder)
        if self.overwrite:
            known = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            for f in known:
                if f.type == fs.FileType.File and f.base_name.endswith(".warc") and not f.base_name.startswith("."):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.hidden:
                system.move(m.hidden, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.folder)
        for m in messages:
            if m is not None and m.hidden:
                system.delete_file(m.hidden)


class HttpMessages(DataSource):
    """Options: path, splitBytes (of a range), maxBytes (of a body)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return " ".join(COLUMNS.split())

    def reader(self, schema: StructType) -> MessageReader:
        return MessageReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> MessageWriter:
        lacking = [c for c in WRITTEN if c not in schema.names]
        if lacking:
            raise ValueError(f"{NAME} needs the columns {', '.join(lacking)}")
        return MessageWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session."""
    ship(spark).dataSource.register(HttpMessages)
    return spark


def read_messages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    return register(spark).read.format(NAME).option("splitBytes", split_bytes).option("maxBytes", max_bytes).load(path)


def write_messages(messages: DataFrame, path: str) -> None:
    """Append messages (columns ``WRITTEN``) to an archive folder."""
    register(messages.sparkSession)
    messages.select(*WRITTEN).write.format(NAME).mode("append").save(path)


def captures_of_messages(messages: DataFrame) -> DataFrame:
    """Page captures of messages: bodies inflated and decoded to ``html``, with site_key and origin.

    A body that isn't what its encoding says stays as it came; a message without a status line gives no capture.
    """
    kept = messages.where("status IS NOT NULL").withColumn("plain", inflate(F.col("body"), F.col("content_encoding")))
    html = decode_body(F.try_element_at("headers", F.lit("content-type")), F.col("plain"))
    named = {"html": html, "site_key": urls.host(F.col("url")), "origin": urls.origin(F.col("url"))}
    return kept.withColumns(named).drop("plain", "body", "error")
