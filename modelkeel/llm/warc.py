"""WARC archives written and read as a chunked record table.

Archives are gzip members, one per record, rolled at ``ROLL_BYTES``. Reading streams every payload as
(record, chunk number) rows of at most ``CHUNK_BYTES`` that carry the digest and length so far, so no record
is ever held whole by the reader.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeel.session import fresh_path, materialise

CHUNK_BYTES = 1 << 20
ROLL_BYTES = 128 << 20
#: The format's version line, its fixed date here, and the profile of an identical payload.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = ("archive string, record_id string, page_id long, record_type string, refers_to long, chunk_no long, "
          "data binary, payload_bytes long, payload_digest string, is_last boolean")
_CHUNK_ARROW = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("is_last", pa.bool_()),
])


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages with digest, length and the page a revisit refers to.

    Only payloads that occur more than once are joined back, from a written table, so the join sees two
    plain exchanges and a payload shared by many pages can be split. Pages of the smallest page_id of a
    payload are responses (all rows of it, if that id is repeated); pages without an id revisit too, and
    are responses if no page of the payload has one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    again = materialise(
        rows.where(F.col("n_bytes") >= min_bytes).groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
        .select("of", "first_id"), "warc-repeats")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return rows.join(again, F.col("digest") == F.col("of"), "left").select("page_id", "url", "html", "digest", "n_bytes", refers.alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _members(row: dict) -> Iterator[bytes]:
    """The record of a page, in pieces."""
    page, refers, payload = row["page_id"], row["refers_to"], (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    body = len(http) + (0 if refers is not None else len(payload))
    head = [
        VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(row['url'] or '', safe=':/?#[]@!$&()*+,;=%-._~')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {body}", f"X-Page-Id: {'' if page is None else page}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page: {refers}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    if refers is None:
        view = memoryview(payload)
        for k in range(0, len(view), CHUNK_BYTES):
            yield view[k : k + CHUNK_BYTES]
    yield b"\r\n\r\n"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "records": records, "bytes": size}])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                for piece in _members(row):
                    size += out.write(packer.compress(piece)) or 0
                out.write(packer.flush())
                records, size = records + 1, out.tell()
                if size >= ROLL_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (see :func:`plan_records`) below ``folder``; the written manifest of archives.

    A file's name is new in every attempt of a task and the manifest names only files of attempts that
    ended well, so a lost executor leaves at most an unnamed file behind.
    """
    return materialise(records.mapInArrow(_writer(folder), "archive string, records long, bytes long"), "warc-manifest")


def _headers(stream) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def _records(stream, archive: str, keep_data: bool) -> Iterator[dict]:
    """Chunk rows of every record of an open archive."""
    while (head := _headers(stream)) is not None:
        left, http_bytes = int(head["content-length"]), 0
        while (line := stream.readline()):
            left -= len(line)
            if line in (b"\r\n", b"\n"):
                break
            if line.lower().startswith(b"content-length:"):
                http_bytes = int(line.split(b":")[1])
        row = {
            "archive": archive, "record_id": head["warc-record-id"], "record_type": head["warc-type"],
            "page_id": int(head["x-page-id"]) if head.get("x-page-id") else None,
            "refers_to": int(head["x-refers-to-page"]) if head.get("x-refers-to-page") else None,
        }
        told = head["warc-payload-digest"].rpartition(":")[2]
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "data": None, "payload_bytes": http_bytes, "payload_digest": told, "is_last": True}
            continue
        digest, size, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(CHUNK_BYTES, left))
            if len(data) < min(CHUNK_BYTES, left):
                raise ValueError(f"{archive}: record {row['record_id']} is cut short")
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield row | {"chunk_no": number, "data": data if keep_data else None, "payload_bytes": size,
                         "payload_digest": digest.hexdigest(), "is_last": left == 0}
            number += 1
            if not left:
                break
        if digest.hexdigest() != told:
            raise ValueError(f"{archive}: payload of {row['record_id']} does not match its digest")


def _reader(keep_data: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    rows, held = [], 0
                    for row in _records(io.BufferedReader(unpacked, CHUNK_BYTES), uri, keep_data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 300
                        if held >= 8 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _CHUNK_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _CHUNK_ARROW)

    return read


def read_chunks(manifest: DataFrame, keep_data: bool = True) -> DataFrame:
    """The record table of all archives of a manifest: a row per record and chunk, in chunk order within a record.

    ``payload_bytes`` and ``payload_digest`` hold what has been read so far; on the last chunk they are those
    of the payload, and are checked against the record's header. A revisit has one row without data.
    """
    files = manifest.select("archive").repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader(keep_data), CHUNKS)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and give one row per record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    chunks = read_chunks(write_archives(plan_records(pages), folder if ":" in folder else f"file://{folder}"), keep_data=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
