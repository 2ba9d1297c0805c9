"""WARC archives: a writer with revisit records, and a salvage reader.

Every record is a gzip member of its own. The reader checks each member, header, length and payload digest; after a failure it searches
for the next member (or, in a plain archive, the next version line) that gives a whole record, goes on there, and reports the skipped
bytes as a quarantined gap. Archives are opened by pyarrow's file systems, so the shared folder may be a store as well as a disk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm.common import cut, scratch

#: Payloads under so many bytes are never revisited.
LEAST_REVISIT = 1000
#: An archive is closed once it has so many bytes.
ROLL = 64 << 20
STEP = 1 << 18
#: Digests of repeated payloads that are broadcast, as counted.
MOST_BROADCAST = 500_000
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes in which the end of a plain record's header is looked for at first; more are read until it, or another record, comes.
HEADER = 1 << 16


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One plain record. digest: the payload's SHA-1 in hex. A revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        head += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE), ("Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(plain: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


class Bad(ValueError):
    """A check failed."""


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Source:
    """Bytes of a file by place, read in steps."""

    def __init__(self, handle: Any):
        self.f, self.at, self.data = handle, 0, b""
        self.size = handle.size() if callable(getattr(handle, "size", None)) else handle.seek(0, 2)

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(max(n, STEP))
        return self.data[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on, or -1."""
        while at < self.size:
            part = self.read(at, STEP + len(what))
            if (i := part.find(what)) >= 0:
                return at + i
            at += STEP
        return -1


def _parse(plain: bytes, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of plain. whole: nothing may follow it."""
    if not plain.startswith(VERSION):
        raise Bad("no version line")
    stop = plain.find(b"\r\n\r\n")
    if stop < 0:
        raise Bad("no end of header")
    lines = plain[:stop].decode("utf-8", "replace").split("\r\n")[1:]
    if any(":" not in x for x in lines):
        raise Bad("bad header line")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    if not headers.get("content-length", "").isdigit():
        raise Bad("no length")
    n = int(headers["content-length"])
    block, end = plain[stop + 4 : stop + 4 + n], stop + 4 + n + 4
    if len(block) < n or plain[end - 4 : end] != b"\r\n\r\n" or whole and end != len(plain):
        raise Bad("length does not fit")
    return headers, block, end


def _checked(offset: int, end: int, headers: dict[str, str], block: bytes) -> Record:
    r = Record(offset, end, headers, block)
    if headers.get("content-type", "").startswith("application/http"):
        top, sep, r.payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise Bad("no end of HTTP header")
        r.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}
        said = headers.get("warc-payload-digest", "")
        if said.startswith("sha1:") and headers.get("warc-type") != "revisit" and said[5:] != base64.b32encode(hashlib.sha1(r.payload).digest()).decode():
            raise Bad("payload digest does not fit")
    return r


def _at(src: Source, at: int) -> Record:
    """The whole and checked record that begins at `at`."""
    if src.read(at, 3) == GZIP:
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if not (part := src.read(pos, min(STEP, src.size - pos))):
                    raise Bad("member is cut off")
                pos += len(part)
                out.append(z.decompress(part))
        except zlib.error as e:
            raise Bad(f"member is damaged: {e}") from None
        end = pos - len(z.unused_data)
        headers, block, _ = _parse(b"".join(out), True)
        return _checked(at, end, headers, block)
    if src.read(at, len(VERSION)) != VERSION:
        raise Bad("neither a member nor a version line")
    n = HEADER
    while True:
        plain = src.read(at, min(n, src.size - at))
        stop = plain.find(b"\r\n\r\n")
        if stop < 0:
            if at + n >= src.size or b"\r\n" + VERSION in plain:
                raise Bad("no end of header")
            n *= 4
            continue
        need = stop + 8 + next((int(x[15:]) for x in plain[:stop].lower().split(b"\r\n") if x.startswith(b"content-length:") and x[15:].strip().isdigit()), 0)
        if len(plain) >= need or at + need > src.size:
            headers, block, end = _parse(plain[:need], False)
            return _checked(at, at + end, headers, block)
        n = need


def read_archive(handle: Any) -> Iterator[Record | Gap]:
    """Every whole record of an archive, and the gaps between them, in order."""
    src, at = Source(handle), 0
    while at < src.size:
        try:
            r = _at(src, at)
        except Bad as why:
            start, reason = at, str(why)
            at, r = _next(src, at + 1)
            yield Gap(start, at, reason)
            if r is None:
                return
        yield r
        at = r.end


def _next(src: Source, at: int) -> tuple[int, Record | None]:
    """The next place at which a whole record begins, and that record; else the end. Candidates are members and version lines,
    which junk may precede on their line."""
    marks = {GZIP: -2, VERSION: -2}
    while True:
        for what, place in marks.items():
            if place != -1 and place < at:
                marks[what] = src.find(what, at)
        found = [p for p in marks.values() if p >= 0]
        if not found:
            return src.size, None
        at = min(found)
        try:
            return at, _at(src, at)
        except Bad:
            at += 1


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


MANIFEST = "path string, records long, bytes long"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, keeper: of payloads of `least` bytes or more that occur more than once, the largest page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    again = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("_n")).filter("_n > 1 AND keeper IS NOT NULL")
    again = cut(again.drop("_n"))
    # Digests of repeated payloads alone, so payloads stay where they are; of too many, the join is shuffled, and a digest that most rows have
    # is split by adaptive execution, as it is in `again` once.
    return rows.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, "digest", "left")


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes gzipped archives of pages (page_id, url, html) into folder, and its manifest as a table under folder/manifest, which is returned.

    A task's archives carry a random name, and only those of the attempt whose rows Spark commits are in the manifest: lost or repeated
    attempts leave files that nobody reads.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_uri(folder)
        system.create_dir(root, recursive=True)
        out, done, path, n, size = None, [], "", 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "keeper")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, keeper = (c[i].as_py() for c in cols)
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                data = member(record(page_id, url, payload, digest, keeper, keeper is not None and keeper != page_id))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    out, done = None, [*done, (path, n, size)]
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    spark = pages.sparkSession
    with_revisits(pages, least).mapInArrow(rows, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = "path string, start long, end long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(paths: DataFrame, payloads: bool = True, whole: bool = False) -> DataFrame:
    """RECORDS of all archives in paths (path): a row for each record and, with `gap` saying why, for each quarantined gap. whole: paths are
    a manifest, and an archive with a gap or with other than its count of records is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist() if whole else [None] * batch.num_rows, strict=True):
                system, at = open_uri(path)
                out, size, n = [], 0, 0
                with system.open_input_file(at) as f:
                    for r in read_archive(f):
                        if isinstance(r, Gap):
                            if whole:
                                raise ValueError(f"{path}: {r.reason} from {r.start} to {r.end}")
                            out.append((path, r.start, r.end, r.reason, None, None, None, None, None, None, None))
                        else:
                            n += 1
                            h = r.headers
                            digest = h.get("warc-payload-digest", "")
                            out.append((path, r.offset, r.end, None, number(h.get("page-id")), h.get("warc-target-uri"), h.get("warc-type"), number(h.get("refers-to-page-id")), number(r.http.get("content-length")), base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None, r.payload if payloads else None))
                            size += len(r.payload)
                        if len(out) >= 2000 or size > STEP * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            out, size = [], 0
                if whole and n != records:
                    raise ValueError(f"{path}: {n} records, {records} written")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return paths.select("path", *(["records"] if whole else [])).mapInArrow(rows, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns what reading them back gives: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload, a null url about:blank. Rows that repeat a payload under the keeper's own page_id are responses like
    it; a row with a null page_id revisits the keeper, and is a response if all ids of its group are null. An empty table gives an empty
    result. Reading back other than what was written is an error.
    """
    archives = write_archives(pages, scratch(spark, "warc"))
    n = max(1, 2 * spark.sparkContext.defaultParallelism)
    records = read_archives(archives.repartition(n), payloads=False, whole=True)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, cast(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""
