"""WARC archives as a PySpark Python data source, read and written.

spark.read.format("warc") plans one partition for each group of files, takes over filters on header
columns (=, IN, prefix, null tests), reads each record's headers first, and inflates and copies a
payload only for records that pass. Gzip members written here carry the `sl` extra field (compressed
and full length), so an unwanted record is stepped over without inflating it; plain records are
stepped over by Content-Length; foreign gzip members are inflated in pieces and dropped.

df.write.format("warc") writes one record per row. Each task attempt writes files of its own; the
commit lists those that count in one manifest file, and the reader keeps to it.

Option payload=false reads headers alone (the record's and the HTTP header). A file larger than option `split`
is cut between members that have the `sl` field; a large foreign file is read by one task. Registered by
`register(spark)`.

Edge cases: header names in any case; an empty table gives an empty archive, which reads as no record; of
page_records see there.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, payload_length long, headers map<string,string>, payload binary"
#: Column: header it comes from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
MANIFEST = "_manifest.json"
#: Bytes of files that one partition reads; bytes after which a writer begins a new file.
SPLIT, ROLL = 64 << 20, 64 << 20
#: Records (and payload bytes) in one batch handed to Spark.
ROWS, BYTES = 1024, 8 << 20
HEAD = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _arrow_schema() -> pa.Schema:
    text = [(c, pa.string()) for c in HEADERS]
    return pa.schema([*text, ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


# -- writing -----------------------------------------------------------------


def _line(name: str, value: object) -> bytes:
    safe = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {safe}\r\n".encode("utf-8", "surrogatepass")


def record(row: dict) -> bytes:
    """One record: response with its payload, revisit with the HTTP header alone."""
    payload = row["payload"] or b""
    response = row["record_type"] == "response"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _line("Content-Type", "text/html; charset=utf-8") + _line("Content-Length", length) + b"\r\n"
    block = http + (payload if response else b"")
    head = [b"WARC/1.1\r\n", _line("WARC-Type", row["record_type"]), _line("WARC-Record-ID", row["record_id"]), _line("WARC-Date", row["date"])]
    for column in ("target_uri", "refers_to", "payload_digest"):
        if row[column] is not None:
            head.append(_line(HEADERS[column], row[column]))
    if row["record_type"] == "revisit":
        head.append(_line("WARC-Profile", REVISIT))
    head += [_line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", len(block)), b"\r\n"]
    return b"".join([*head, block, b"\r\n\r\n"])


def member(raw: bytes, level: int) -> bytes:
    """A gzip member whose extra field `sl` has its compressed and its full length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if max(size, len(raw)) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Options: path, level (gzip level, 0 for plain records), roll (bytes of a file)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.roll = int(options.get("level", "1")), int(options.get("roll", str(ROLL)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, n, out, size = [], 0, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * bool(self.level))
                    out, size = where.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                raw = record(row)
                raw = member(raw, self.level) if self.level else raw
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out:
            out.close()
        return Written(files, n)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        files, before = sorted(f for m in messages if m for f in m.files), _listed(where, root) or []
        if not self.overwrite:
            files = sorted({*files, *before})
        with where.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps({"files": files}).encode())
        where.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        if self.overwrite:
            for f in {*before} - {*files}:
                where.delete_file(f"{root}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            where.delete_file(f"{root}/{f}")


# -- reading -----------------------------------------------------------------


def _listed(where: fs.FileSystem, root: str) -> list[str] | None:
    """The files that a manifest names, or None without one."""
    if where.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with where.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def parse_head(raw: bytes) -> dict[str, str]:
    """Header lines after the version line; a line that begins with space continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "surrogatepass")
        elif b":" in line:
            name, _, value = line.partition(b":")
            last = name.strip().decode("ascii", "replace")
            out[last] = value.strip().decode("utf-8", "surrogatepass")
    return out


def columns_of(headers: dict[str, str]) -> dict[str, str | None]:
    by_lower = {k.lower(): v for k, v in headers.items()}
    return {column: by_lower.get(name.lower()) for column, name in HEADERS.items()}


def passes(filters: Sequence[Filter], row: dict[str, str | None]) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        if isinstance(f, EqualTo):
            ok = value is not None and value == f.value
        elif isinstance(f, In):
            ok = value is not None and value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        elif isinstance(f, IsNull):
            ok = value is None
        else:
            ok = value is not None
        if not ok:
            return False
    return True


class Source:
    """Buffered reads and seeks over an open file of any file system."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.block, self.base, self.at = raw, size, b"", 0, 0

    def read(self, n: int) -> bytes:
        own = self.block[self.at - self.base : self.at - self.base + n] if self.at >= self.base else b""
        if len(own) < n:
            self.raw.seek(self.at + len(own))
            more = self.raw.read(max(self.size, n - len(own)))
            self.base, self.block = self.at, own + more
            own = self.block[:n]
        self.at += len(own)
        return own

    def readline(self) -> bytes:
        line = b""
        while part := self.read(512):
            cut = part.find(b"\n") + 1
            if cut:
                self.at -= len(part) - cut
                return line + part[:cut]
            line += part
        return line


class _Inflater:
    """Inflates one member of an open file, piece by piece."""

    def __init__(self, source: Source, have: bytes, left: int | None):
        self.source, self.left, self.data, self.z = source, left, have, zlib.decompressobj(-15)

    def more(self, most: int) -> bytes:
        """Up to `most` further inflated bytes; empty at the member's end."""
        while not self.z.eof:
            if not self.data:
                self.data = self.source.read(1 << 16 if self.left is None else min(1 << 16, self.left))
                if not self.data:
                    raise EOFError("a gzip member is cut off")
                if self.left is not None:
                    self.left -= len(self.data)
            out = self.z.decompress(self.data, most)
            self.data = self.z.unconsumed_tail
            if out:
                return out
        return b""


def records(source: Source, filters: Sequence[Filter] = (), payload: bool = True, stop: float = float("inf")) -> Iterator[tuple[dict, dict[str, str], int, bytes | None]]:
    """(header columns, all headers, payload length, payload) of the records that pass and begin before stop."""
    while source.at < stop and (start := source.read(2)):
        source.at -= len(start)
        if start == b"\x1f\x8b":
            yield from _gzip_record(source, filters, payload)
        elif start in (b"\r\n", b"\n"):
            source.read(len(start))
        else:
            yield from _plain_record(source, filters, payload)


def _length(headers: dict[str, str]) -> int | None:
    """Content-Length, however its name is written."""
    said = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
    return int(said) if said.isdigit() else None


def _block(more, n: int, payload: bool) -> tuple[int, bytes | None]:
    """(payload length as the HTTP header says or as it is, payload) of a block of n bytes, of which more(most) gives the next.

    Without the payload only as much is read as the HTTP header takes.
    """
    raw = bytearray()
    while len(raw) < n and (payload or raw[:5] == b"HTTP/"[: len(raw)] and b"\r\n\r\n" not in raw) and (got := more(n - len(raw) if payload else min(HEAD, n - len(raw)))):
        raw += got
    block = bytes(raw[:n])
    head, found, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not found:
        return n if not payload else len(block), block if payload else None
    said = _length(parse_head(head))
    return said if said is not None else n - len(head) - 4, body if payload else None


def _plain_record(source, filters, payload):
    head = bytearray()
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        head += line
    headers = parse_head(bytes(head))
    row, n, at = columns_of(headers), _length(headers) or 0, source.at
    if passes(filters, row):
        size, body = _block(source.read, n, payload)
        yield row, headers, size, body
    source.at = at + n


def _gzip_record(source, filters, payload):
    fixed = source.read(10)
    flags, left = fixed[3], None
    if flags & 4:
        (n,) = struct.unpack("<H", source.read(2))
        extra = source.read(n)
        if extra[:2] == b"sl" and len(extra) >= 12:
            left = struct.unpack("<I", extra[4:8])[0] - 12 - n
    for bit in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & bit:
            while source.read(1) not in (b"\0", b""):
                pass
    if flags & 2:
        source.read(2)
    end = None if left is None else source.at + left
    z = _Inflater(source, b"", left)
    raw = b""
    while b"\r\n\r\n" not in raw and (got := z.more(HEAD)):
        raw += got
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = parse_head(head)
    row = columns_of(headers)
    if passes(filters, row):
        size, body = _block(lambda most, left=[rest]: left.pop() if left and left[0] else z.more(most), _length(headers) or 0, payload)
        yield row, headers, size, body
    if end is not None:
        source.at = end
    else:
        while z.more(1 << 16):
            pass
        source.at += 8 - len(z.z.unused_data)  # the trailer; what was read too far is read again


#: How a gzip member with the `sl` field begins; fixed, as `member` writes it.
SIGNATURE = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"


def seek_member(source: Source, stop: int) -> bool:
    """Go to the next place before stop where a member with the `sl` field begins."""
    while source.at < stop:
        got = source.read(1 << 16)
        found = got.find(SIGNATURE)
        if found >= 0:
            source.at -= len(got) - found
            return source.at < stop
        if len(got) <= len(SIGNATURE):
            return False
        source.at -= len(SIGNATURE) - 1
    return False


class Files(InputPartition):
    """Stretches of files: (path, first byte, byte before which records begin)."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split", str(SPLIT)))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | IsNull | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Groups of files of about `split` bytes. A larger file is cut where its members have the `sl` field, else it stands alone."""
        where, root = fs.FileSystem.from_uri(self.path)
        listed = _listed(where, root) if where.get_file_info(root).type == fs.FileType.Directory else None
        if listed is not None:
            infos = where.get_file_info([f"{root}/{f}" for f in listed])
        elif where.get_file_info(root).type == fs.FileType.File:
            infos = [where.get_file_info(root)]
        else:
            infos = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))]
        out, size = [], self.split
        for info in sorted(infos, key=lambda i: i.path):
            step = info.size
            if info.size > self.split:
                with where.open_input_file(info.path) as f:
                    step = self.split if f.read(len(SIGNATURE)) == SIGNATURE else info.size
            for at in range(0, info.size, max(1, step)):
                own = min(step, info.size - at)
                if size + own > self.split:
                    out.append([])
                    size = 0
                out[-1].append((info.path, at, at + own))
                size += own
        return [Files(files) for files in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        schema, rows, size = _arrow_schema(), [], 0
        for path, at, stop in partition.files:
            with where.open_input_file(path) as raw:
                source = Source(raw)
                source.at = source.base = at
                if at and not seek_member(source, stop):
                    continue
                for row, headers, n, payload in records(source, self.filters, self.payload, stop):
                    rows.append({**row, "payload_length": n, "headers": list(headers.items()), "payload": payload})
                    size += len(payload or b"")
                    if len(rows) >= ROWS or size >= BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages as records ---------------------------------------------------------

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: A digest's rows are joined under so many salts, so that a payload held by many pages is spread.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records of all pages, in the columns that the writer takes.

    Of equal payloads of at least LEAST_REVISIT bytes the row with the smallest id is the response
    and the others revisit it. A null html is an empty payload. Rows with a null id revisit like
    others but are never revisited; a repeated row of the smallest id is a response again. Pages
    carry no time, so all records have the same date.
    """
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"_sha": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long"), "_salt": F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")})
    again = rows.where(F.col("payload_length") >= LEAST_REVISIT).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    again = again.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = rows.join(again.hint("merge"), ["_sha", "_salt"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        urn("_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.when(revisit, urn("_first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("_sha")).alias("payload_digest"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        "payload_length",
        F.create_map().cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id(urn: str):
    """The id in a record's urn."""
    return F.regexp_extract(F.col(urn), r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
