"""WARC archives as a PySpark data source, format("warc").

Reading: a partition is a run of whole files up to a size; filters on record type and header columns (=, IN, prefix, IS [NOT] NULL) are
pushed into the source. Archives hold one gzip member per record, written with the "sl" extra field that tells a member's compressed size:
the reader inflates a member only until its headers end, tests the filters, and where they fail, or where the schema asked for
has no payload column, seeks past the rest. Members without the field (other writers' archives) are inflated to find their end.

Writing: each task writes a file of its own under a temporary name; the driver renames the files of the attempts that won and deletes what other
attempts of the same write left. Names hold the write's own id, so an append keeps what is there; an overwrite deletes the archives that were
there once its own files have their names. Paths may be on any filesystem that pyarrow opens.

Cases: null payloads are empty; a record without an id or target gets an empty header value, read back as null; white space in an id or
target is written percent-encoded; empty input gives no files and no rows (an overwrite with it leaves no archive); of equal payloads the record with the largest id is the response (all of them, if that id repeats), records without an
id revisit it; with no id among them all are responses; very long payloads are written whole (a member of 4 GB or more carries no
size and is inflated to find its end); extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import cut, read, scratch, small_side

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary, file string"
#: Columns that are read from a record's headers, and the headers that hold them.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PARTITION_BYTES = 32 << 20
#: Bytes fetched at a time, and bytes handed to the inflater at a time.
CHUNK, STEP = 1 << 20, 1 << 13


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return fs, path.rstrip("/")


def archives(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """The archives under a folder, or the file itself."""
    info = fs.get_file_info(path)
    if info.is_file:
        return [info]
    return [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and x.base_name.endswith(".warc.gz") and not x.base_name.startswith((".", "_"))]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str | None, uri: str | None, refers_to: str | None, payload: bytes, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit holds the response's HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind != "revisit" else b"")
    clean = lambda x: re.sub(r"\s", lambda m: quote(m[0]), x) if x else ""  # noqa: E731  a header value can't hold line ends
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{clean(record_id)}>", f"WARC-Target-URI: {clean(uri)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{clean(refers_to)}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32 or len(raw) >= 1 << 32:  # the field can't tell it
        return b"\x1f\x8b\x08\0\0\0\0\0\x04\xff" + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Member:
    """A gzip member that is inflated as far as asked."""

    def __init__(self, f, at: int):
        f.seek(at)
        start = f.read(STEP)
        self.f, self.at, self.skip = f, at, None
        if start[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        if start[3] & 4:
            end = 12 + struct.unpack("<H", start[10:12])[0]
            while len(start) < end and (x := f.read(end - len(start))):  # an extra field may be longer than a step
                start += x
            p = 12
            while p + 4 <= end:
                n = struct.unpack("<H", start[p + 2 : p + 4])[0]
                if start[p : p + 2] == b"sl" and n == 8:
                    self.skip = struct.unpack("<I", start[p + 4 : p + 8])[0]
                p += 4 + n
        self.z, self.waiting, self.read = zlib.decompressobj(31), start, len(start)

    def more(self, most: int) -> bytes:
        """Up to `most` further bytes; empty at the member's end."""
        while not self.z.eof:
            if not self.waiting:
                self.waiting = self.f.read(STEP)
                self.read += len(self.waiting)
                if not self.waiting:
                    raise ValueError(f"the member at byte {self.at} is cut short")
            out = self.z.decompress(self.waiting, most)
            self.waiting = self.z.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        """Where the next member begins."""
        if self.skip and not self.z.eof:
            return self.at + self.skip
        while self.more(CHUNK):
            pass
        return self.at + self.read - len(self.z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k:
            out[k.strip().lower()] = v.strip()
    return out


def records(f, size: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, length of the whole payload, payload or None) of the records whose headers pass."""
    at = 0
    while at < size:
        m = _Member(f, at)
        buf = b""
        while b"\r\n\r\n" not in buf and (x := m.more(1024)):
            buf += x
        head, _, rest = buf.partition(b"\r\n\r\n")
        fields = _fields(head)
        if wanted(fields):
            need = int(fields.get("content-length", 0))
            http = "application/http" in fields.get("content-type", "")
            parts, have = [rest], len(rest)
            while have < need and (payloads or http and b"\r\n\r\n" not in b"".join(parts)) and (x := m.more(CHUNK if payloads else 1024)):
                parts.append(x)
                have += len(x)
            block = b"".join(parts)[:need]
            length, body = need, block
            if http:
                inner, _, body = block.partition(b"\r\n\r\n")
                stated = _fields(inner).get("content-length", "")
                length = int(stated) if stated.isdigit() else need - len(inner) - 4
            yield fields, length, body if payloads else None
        at = m.end()


def column(fields: dict[str, str], name: str) -> str | None:
    x = fields.get(HEADERS[name])
    if x and name in ("record_id", "refers_to"):
        x = x.removeprefix("<").removesuffix(">")
    if x and name == "payload_digest":
        x = x.rpartition(":")[2]
    return x or None


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __init__(self, files):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.uri = options["path"]
        self.verify = options.get("verify", "false").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "=", In: "in", StringStartsWith: "prefix", IsNull: "null", IsNotNull: "some"}.get(type(f))
            if name in HEADERS and kind:
                self.tests.append((name, kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            x = column(fields, name)
            if not (x is None if kind == "null" else x is not None and (kind == "some" or kind == "=" and x == value or kind == "in" and x in value or kind == "prefix" and x.startswith(value))):
                return False
        return True

    def partitions(self):
        fs, path = filesystem(self.uri)
        root = self.uri[: self.uri.rindex(path)] if path in self.uri else ""
        out, size = [], self.most
        for x in sorted(archives(fs, path), key=lambda x: x.path):
            if size + x.size > self.most:
                out.append([])
                size = 0
            out[-1].append((root + x.path, x.size))
            size += x.size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition):
        payloads = "payload" in self.fields or self.verify
        rows: list[tuple] = []
        size = 0
        for uri, length in partition.files:
            fs, path = filesystem(uri)
            with fs.open_input_file(path) as raw:
                for fields, n, body in records(io.BufferedReader(raw, CHUNK), length, self.wanted, payloads):
                    if self.verify and fields.get("warc-type") == "response" and (len(body) != n or digest_of(body) != column(fields, "payload_digest")):
                        raise ValueError(f"{uri}: the payload of {column(fields, 'record_id')} isn't what its headers say")
                    known = {"payload_length": n, "headers": fields, "payload": body, "file": uri}
                    rows.append(tuple(known[c] if c in known else column(fields, c) for c in self.fields))
                    size += len(body or b"") + 256 if "payload" in self.fields else 256
                    if size > 8 << 20:
                        yield from rows
                        rows, size = [], 0
        yield from rows


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str

    def __init__(self, temporary, final):
        self.temporary, self.final = temporary, final


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_type, record_id, target_uri, refers_to and payload; they arrive as Arrow batches."""

    def __init__(self, options, overwrite=False):
        self.uri = options["path"]
        self.overwrite = overwrite
        self.id = uuid.uuid4().hex  # of this write: tasks and the driver get copies of this object

    def write(self, iterator):
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        message = Written(f"{path}/.{self.id}-{uuid.uuid4().hex}.tmp", f"{path}/part-{part:06d}-{self.id}.warc.gz")
        some = False
        with fs.open_output_stream(message.temporary) as f:
            for b in iterator:
                columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("record_type", "record_id", "target_uri", "refers_to")]
                for kind, number, uri, other, payload in zip(*columns, b.column(b.schema.get_field_index("payload")), strict=True):
                    payload = payload.as_py()
                    f.write(record(kind, number, uri, other, payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload or b""))
                    some = True
        if not some:
            fs.delete_file(message.temporary)
        return message if some else Written("", "")

    def commit(self, messages):
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)  # a write of no partitions has no task that made it
        old = [x for x in archives(fs, path) if self.id not in x.base_name] if self.overwrite else []
        for m in messages:
            if m is not None and m.temporary:
                fs.move(m.temporary, m.final)
        for x in old:
            fs.delete_file(x.path)
        self._tidy(fs, path)

    def abort(self, messages):
        self._tidy(*filesystem(self.uri))

    def _tidy(self, fs, path):
        """Deletes the temporary files of this write."""
        for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if x.is_file and x.base_name.startswith(f".{self.id}-"):
                fs.delete_file(x.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, uri: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """The records under uri; name only the columns that are wanted: without payload, payloads aren't inflated."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(uri)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows for the writer; of equal payloads of at least least_bytes only that of the largest page_id is a response.

    Payloads are matched by their SHA-1 on narrow rows, pre-aggregated before the shuffle; html itself moves only if the table of revisits is too large to
    broadcast, and then by page_id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    narrow = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n"))
    same = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("times")).where("times > 1 and top is not null")
    of = cut(same, "warc-same")
    revisits = cut(narrow.where(F.col("n") >= least_bytes).join(small_side(of), "digest").where("page_id is null or page_id < top").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "top").distinct(), "warc-revisits")
    joined = pages.join(small_side(revisits), F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("_digest")), "left")
    urn = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    return joined.select(F.when(F.col("top").isNull(), "response").otherwise("revisit").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), urn(F.col("top")).alias("refers_to"), F.encode("html", "UTF-8").alias("payload"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch(spark, "warc")
    page_records(read(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    page = lambda c: F.regexp_extract(c, r"(-?[0-9]+)$", 1).try_cast("long")
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_length long"
    responses = read_warc(spark, path, columns, verify=True).where("record_type = 'response'")  # payloads inflated and held against their digests
    revisits = read_warc(spark, path, columns).where("record_type = 'revisit'")  # from headers alone; the type test is in the source in both
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS top, count(*) AS n FROM p GROUP BY h),
x AS (SELECT p.page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS hex, n > 1 AND top IS NOT NULL AND (p.page_id IS NULL OR p.page_id < top) AS again, top FROM p JOIN g ON p.h = g.h),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
  (CASE WHEN ((strpos('0123456789abcdef', substr(hex, 1 + CAST(floor((i * 5 + j) / 4) AS INTEGER), 1)) - 1) & CAST(2 ** (3 - (i * 5 + j) % 4) AS BIGINT)) > 0 THEN CAST(2 ** (4 - j) AS BIGINT) ELSE 0 END)))::BIGINT, 1)) AS digits FROM x)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(digits, '') AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM b
"""
