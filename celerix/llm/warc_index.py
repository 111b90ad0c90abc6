"""WARC archives with a two-level capture index.

Archives are .warc.gz files of one gzip member per record. The index lists captures by reversed-host URL key
(`org,example)/path`) in ascending order, cut into compressed blocks of BLOCK lines; a sparse directory holds the first
key and the place of each block. A lookup searches the directory by bisection, reads one range for the block, bisects
in it, and reads one range for each record. Files are written by tasks below the shared folder through pyarrow's file
systems, under names of their own for each attempt; only what a finished task returned is referred to.

Payloads of at least LEAST bytes that equal an earlier one become revisit records without a body; the response is the
record with the least page_id. Defined cases: null html is an empty payload, a null url has the key ``, page rows that
repeat the least page_id with the same payload are all responses, a null page_id comes after all others; an empty
table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celerix.llm.common import bounded, pieces, stored, work_dir

LEAST = 100
BLOCK = 1024
FILE_BYTES = 64 << 20
LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"  # the tables have no capture time
_head = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)\r\n")


def surt(url: str | None) -> str:
    """Sort key: host labels reversed and joined by commas, `)`, then path and query; scheme, user, a leading www and default ports go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url.strip().lower()
    host = host.removeprefix("www.")
    at = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; refers_to set: a revisit without a body."""
    revisit = refers_to is not None
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    end = raw.index(b"\r\n\r\n") + 2
    headers = {k.decode(): v.decode() for k, v in _head.findall(raw[raw.index(b"\r\n") + 2 : end])}
    size = int(headers["Content-Length"])
    return headers, raw[end + 2 : end + 2 + size]


def _packed(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """A task's output files, cut at FILE_BYTES; each name is used by one attempt only."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.out, self.at = folder, suffix, None, 0
        self.fs, self.base = _fs(folder)

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= FILE_BYTES:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return f"{self.folder}/{self.name}", self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Range reads; the file read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            fs, at = _fs(path)
            self.path, self.file = path, fs.open_input_file(at)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all pages below folder; stored: key, page_id, path, offset, length of every record."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    first = base.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    told = base.join(first, (base["digest"] == first["d"]) & (base["size"] >= LEAST), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = told.select("page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            for part in pieces(batch, "payload"):
                out: list[tuple] = []
                for page, url, digest, size, refers_to, payload in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "refers_to", "payload")), strict=True):
                    packed = _packed(record(page, url, digest, size, payload or b"", refers_to))
                    path, offset = files.write(packed)
                    out.append((surt(url), page, path, offset, len(packed)))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], ["key", "page_id", "path", "offset", "length"])
        files.close()

    return stored(rows.mapInArrow(run, "key string, page_id long, path string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Index blocks below folder; stored: the directory (first_key, path, offset, length, n), one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = _Files(folder, ".cdx.gz"), []

        def cut(lines: list[tuple]) -> tuple:
            packed = _packed("".join("\t".join(["" if v is None else str(v) for v in line]) + "\n" for line in lines).encode())
            path, offset = files.write(packed)
            return (lines[0][0], path, offset, len(packed), len(lines))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], ["first_key", "path", "offset", "length", "n"])

        for batch in batches:
            held += zip(map(_line_key, batch.column("key").to_pylist()), *(batch.column(c).to_pylist() for c in ("page_id", "path", "offset", "length")), strict=True)
            done = []
            while len(held) >= block:
                done.append(cut(held[:block]))
                del held[:block]
            if done:
                yield out(done)
        if held:
            yield out([cut(held)])
        files.close()

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(ordered.mapInArrow(run, "first_key string, path string, offset long, length long, n long"), "directory")


def _line_key(key: str) -> str:
    return re.sub(r"[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", key)


def _lines(packed: bytes) -> list[tuple[str, int | None, str, int, int]]:
    rows = (x.split("\t") for x in zlib.decompress(packed, 31).decode().split("\n")[:-1])
    return [(k, int(p) if p else None, path, int(o), int(n)) for k, p, path, o, n in rows]


def _fields(raw: bytes) -> tuple:
    headers, body = parse(raw)
    ref = headers.get("WARC-Refers-To", "")
    kind = headers["WARC-Type"]
    page = headers["WARC-Record-ID"][10:-1]
    told = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(body).hexdigest() != told:
        raise ValueError(f"record of page {page}: payload and digest differ")
    return int(page) if page else None, headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), told, kind, int(ref[10:-1]) if ref else None, body


def read_archives(directory: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record that the index lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload; a revisit's is empty)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                lines = _lines(ranges.read(path, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in lines], pa.string()), pa.array([x[3] for x in lines], pa.int64()), pa.array([x[4] for x in lines], pa.int64())], ["path", "offset", "length"])
        ranges.close()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = [_fields(zlib.decompress(ranges.read(path, offset, length), 31)) for path, offset, length in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)
        ranges.close()

    places = directory.select("path", "offset", "length").repartition("path", "offset").mapInArrow(unpack, "path string, offset long, length long")
    # records of one stretch of a file are read by one task, in order
    stretch = F.floor(F.col("offset") / (4 << 20))
    ordered = places.repartition("path", stretch).sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


class CaptureIndex:
    """Lookups of single urls. The directory stays with Spark; a lookup fetches the rows that bracket the key."""

    def __init__(self, directory: DataFrame):
        self.directory = directory.select("first_key", "path", "offset", "length")
        self.held: list[tuple] | None = None

    def load(self, most: int = 1_000_000) -> CaptureIndex:
        """Hold the directory on the driver for bisection, if it has at most `most` rows; else lookups search it by filter."""
        if self.directory.count() <= most:
            self.held = sorted(tuple(r) for r in self.directory.collect())
        return self

    def _blocks(self, key: str) -> list[tuple]:
        if self.held is None:
            before = self.directory.filter(F.col("first_key") < key).agg(F.max("first_key")).first()[0]
            return sorted(tuple(r) for r in self.directory.filter(F.col("first_key").between(before or "", key)).collect())
        lo = max(0, bisect.bisect_left(self.held, (key,)) - 1)
        hi = bisect.bisect_right(self.held, key, key=lambda r: r[0])
        return self.held[lo:hi]

    def lookup(self, url: str) -> list[dict]:
        """All captures of the url's key, in page_id order, each with its payload (a revisit's is empty)."""
        key, out, ranges = _line_key(surt(url)), [], _Ranges()
        for _, path, offset, length in self._blocks(key):
            lines = _lines(ranges.read(path, offset, length))
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                _, _, where, start, size = lines[at]
                names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
                out.append(dict(zip(names, _fields(zlib.decompress(_Ranges().read(where, start, size), 31)), strict=True)))
                at += 1
        ranges.close()
        return sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"]))


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives and index of all pages in the shared folder; the directory."""
    folder = work_dir(spark, "warc")
    return write_index(write_archives(pages, f"{folder}/archive"), f"{folder}/index")
