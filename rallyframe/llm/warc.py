"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes one archive of gzip members, one a record, and returns where each record lies: file,
offset, length, url, digest. The returned rows are the index. An archive of a task that was lost or ran
twice is in no index row, so retries do no harm. Readers select index rows, sort them by file and
offset, and read neighbouring records in one request.

Equal payloads are stored once: the row with the largest id is the response, the others revisits, that
keep the HTTP head (with the payload's length), its digest, and the id referred to.

At scale: payloads are not shuffled unless the table of repeated digests is large; then that join
can be split by Spark, so one payload that fills a third of all rows does no harm. Reading sorts index
rows only: stretches of files are dealt out to tasks whose number follows from the bytes to read. Archives lie in the folder all executors share, through any file system that pyarrow knows.

Defined cases: null html is an empty payload, and empty payloads are equal; null urls have no target
header; payloads of any length are written and read whole, one at a time; rows with equal id and payload are each a response if
that id is the largest; of a group whose ids are all null each is a response; an empty table gives no archive and an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

#: The bound on digests that go to every executor: 50 bytes each, so 10 MB at most.
BROADCAST_DIGESTS = 200_000
#: Largest byte range read at once, and largest gap read over.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of a stretch of a file that one task reads, and of all that a task gets, more only where there would be over MOST_TASKS.
TASK_BYTES, MOST_TASKS = 1 << 20, 50_000
ID = "urn:x-page:"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers, lower-cased, with its HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    found = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return found | {"payload": payload, "payload-length": int(length[1]) if length else len(payload)}


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _writer(folder: str, date: str, level: int):
    names = [x.split()[0] for x in INDEX.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)))

    def write(batches):
        import uuid

        system, root = fs.FileSystem.from_uri(folder)
        name, out, at = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, url, html, sha, first = (c[i].as_py() for c in batch.columns)
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                digest = base32(bytes.fromhex(sha))
                refers = first if first is not None and first != page else None
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, html.encode(), digest, refers, date)) + packer.flush()
                out.write(member)
                rows.append((page, f"{folder}/{name}", at, len(member), url, digest, "response" if refers is None else "revisit", refers))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if out is not None:
            out.close()

    return write


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes archives under folder and returns their index.

    Equal payloads shorter than least_bytes are all kept in full.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    full = pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"))
    long_enough = F.octet_length("html") >= least_bytes
    again = written(full.filter(long_enough).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first"), "repeated")
    if again.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    joined = full.join(again, "sha", "left").select("page_id", "url", "html", "sha", "first")
    return written(joined.mapInArrow(_writer(folder, date, level), INDEX), "index")


def ranges(rows, most: int = RANGE_BYTES, gap: int = GAP_BYTES):
    """Runs of (file, offset, length), sorted, that one request can serve."""
    run: list = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > gap or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _reader(with_payload: bool):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
    schema = pa.schema(list(zip((x.split()[0] for x in RECORD.split(", ")), kinds, strict=True)))

    def number(x: str | None) -> int | None:
        tail = (x or "").strip("<>").removeprefix(ID)
        return int(tail) if tail else None

    def read(batches):
        opened: dict = {}
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for run in ranges(rows):
                path = run[0][0]
                if path not in opened:
                    for old in opened.values():
                        old.close()
                    system, local = fs.FileSystem.from_uri(path)
                    opened = {path: system.open_input_file(local)}
                start = run[0][1]
                data = opened[path].read_at(run[-1][1] + run[-1][2] - start, start)
                out = []
                for _, offset, length in run:
                    got = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    kind, payload, digest = got["warc-type"], got["payload"], got["warc-payload-digest"].removeprefix("sha1:")
                    intact = kind == "revisit" or base32(hashlib.sha1(payload).digest()) == digest and len(payload) == got["payload-length"]
                    out.append((number(got["warc-record-id"]), got.get("warc-target-uri"), kind, number(got.get("warc-refers-to")), got["payload-length"], digest, payload if with_payload and kind == "response" else None, intact))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return read


def read_warc(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of index point to; intact tells whether the payload has its digest."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, -(-total // TASK_BYTES)))
    where = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")
    return where.mapInArrow(_reader(with_payload), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Writes every page to archives in the shared folder and reads every record back."""
    index = write_warc(pages, fresh_path(spark, "warc"), id)
    got = read_warc(index, with_payload=False)
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload lost its digest: "), F.col("page_id").cast("string"))))
    return got.select(F.col("page_id").alias(id), "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


#: The same rows in SQL; 5 hexadecimal digits of a digest are 4 letters of base 32.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS x FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(x, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
