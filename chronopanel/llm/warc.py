"""WARC archives as a table of chunks.

A record is rows (record, chunk number): no task holds a whole payload longer than a chunk, neither when archives are
written nor when they are read. Byte counts and digests are carried from chunk to chunk, so the last row of a record
has those of the whole payload and nothing need be gathered again.

Archives are gzip files with a member per record. Each task writes a file of its own and reports it in a manifest;
files of lost attempts are in no manifest and so never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.registry import query, table
from chronopanel.session import materialize, new_folder

CHUNK_BYTES = 1 << 20
# Payloads that occur more than once, by their digests of 40 bytes, that may be broadcast.
MAX_BROADCAST_ROWS = 100_000
_ID = "urn:x-record:"


def chunk_rows(records: DataFrame, payload: str = "payload", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``records`` with rows (chunk, data) in place of the binary column ``payload``: one at least, in order, together."""
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    last = F.greatest(F.floor((size - 1) / chunk_bytes), F.lit(0)).cast("int")
    keep = [c for c in records.columns if c != payload]
    return records.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).select(
        *keep, "chunk", F.coalesce(F.substring(F.col(payload), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)), F.lit(b"")).alias("data"))


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` (id, payload, ..) with n_bytes, digest (hex SHA-1), type, refers_to.

    Of records with equal payloads of ``min_bytes`` at least, the one with the largest id is the response and the
    others revisit it. Equal digests are counted before they are dealt out; only digests that occur more than once
    are joined back.
    """
    data = F.coalesce(F.col("payload"), F.lit(b""))
    src = records.withColumn("payload", data).withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    often = (
        src.filter(F.col("n_bytes") >= min_bytes).groupBy(F.col("digest").alias("__d"))
        .agg(F.count(F.lit(1)).alias("__n"), F.max("id").alias("__first")).filter("__n > 1 AND __first IS NOT NULL").drop("__n")
    )
    often = materialize(often)
    often = F.broadcast(often) if often.count() <= MAX_BROADCAST_ROWS else often
    revisits = F.col("__first").isNotNull() & ~F.col("id").eqNullSafe(F.col("__first"))
    return (
        src.join(often, F.col("digest") == F.col("__d"), "left")
        .withColumn("type", F.when(revisits, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisits, F.col("__first")))
        .drop("__d", "__first")
    )


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(row: dict, date: str) -> bytes:
    """WARC and HTTP headers of a record, as far as the payload."""
    revisit = row["type"] == "revisit"
    length = 0 if revisit else row["n_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{_ID}{row['id']}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((row["url"] or "").split()), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['digest']))}", f"X-Payload-Length: {row['n_bytes']}", f"Content-Length: {len(http) + length}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, level: int = 1) -> DataFrame:
    """Write ``records`` (id, url, payload, n_bytes, digest, type, refers_to), a file per task; return the manifest
    (path, records, bytes), stored.

    A record goes out chunk by chunk; its digest is checked as it does.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # A revisit has no payload of its own in the archive.
    rows = chunk_rows(records.withColumn("payload", F.when(F.col("type") == "response", F.col("payload"))), "payload", chunk_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, count = None, "", 0
        packer, sha, expected = None, None, None

        def finish() -> None:
            if sha is not None and sha.hexdigest() != expected:
                raise ValueError("a payload's chunks do not make up its digest")
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            fields = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(fields, batch.column("data"), strict=True):
                if out is None:
                    system, root = opened(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder.rstrip('/')}/{name}"
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                if row["chunk"] == 0:
                    if packer:
                        finish()
                    packer, count = zlib.compressobj(level, wbits=31), count + 1
                    sha, expected = (hashlib.sha1(), row["digest"]) if row["type"] == "response" else (None, None)
                    out.write(packer.compress(_header(row, date)))
                part = data.as_py()
                if sha is not None:
                    sha.update(part)
                out.write(packer.compress(part))
        if out is not None:
            finish()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return materialize(rows.mapInArrow(write, "path string, records bigint, bytes bigint"))


class _Members:
    """The bytes of a gzip file of one or more members, read forward in pieces."""

    def __init__(self, stream, piece: int = 1 << 18) -> None:
        self.stream, self.piece, self.buffer, self.packer, self.raw = stream, piece, bytearray(), zlib.decompressobj(wbits=31), b""

    def fill(self) -> bool:
        """Append some bytes to the buffer; False at the end."""
        while True:
            if self.packer.eof:
                self.raw, self.packer = self.packer.unused_data, zlib.decompressobj(wbits=31)
            source = self.raw or self.packer.unconsumed_tail or self.stream.read(self.piece)
            self.raw = b""
            if not source:
                return False
            data = self.packer.decompress(source, self.piece)
            if data:
                self.buffer += data
                return True

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes | None:
        """What stands before ``mark``, which is skipped; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if seen > limit:
                raise ValueError("a header of more than 1 MB")
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self.fill():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(stream, chunk_bytes: int) -> Iterator[dict]:
    """Rows (record by record, chunk by chunk) of an open archive."""
    source = _Members(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        left = int(fields.get("content-length", 0))
        if fields.get("content-type", "").startswith("application/http") and left:
            left -= len(source.until(b"\r\n\r\n")) + 4
        strip = lambda v: v.strip("<>").removeprefix(_ID) if v else None
        sha, done, chunk = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(chunk_bytes, left))
            left -= len(data)
            done += len(data)
            sha.update(data)
            yield {
                "record_id": strip(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
                "refers_to": strip(fields.get("warc-refers-to")), "header_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "header_bytes": int(fields["x-payload-length"]) if "x-payload-length" in fields else None,
                "chunk": chunk, "data": data, "bytes_so_far": done, "digest_so_far": base32(sha.digest()), "last": not left,
            }
            chunk += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


CHUNKS = ("record_id string, record_type string, target_uri string, refers_to string, header_digest string, header_bytes bigint, "
          "chunk int, data binary, bytes_so_far bigint, digest_so_far string, last boolean")


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives named in ``manifest.path``; a file is read by one task, forward only."""
    kinds = [f.split() for f in CHUNKS.split(", ")]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, arrow[k]) for n, k in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = opened(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for row in read_records(stream, chunk_bytes):
                        size += len(row["data"]) + 500
                        rows.append(row if with_data else row | {"data": None})
                        if size > 4 * chunk_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("path")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(read, CHUNKS)


def record_digests(chunks: DataFrame) -> DataFrame:
    """A row per record, from its last chunk: what its headers say of a revisit, what was counted of any other."""
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("last").select(
        "record_id", F.when(revisit, F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", "refers_to", "target_uri")


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 0) -> DataFrame:
    """Write a WARC record per row and return the manifest.

    A null page is an empty payload, and all empty payloads are equal. A null id is written as "None" and is
    never the one referred to. Rows that share the largest id of a payload are all responses. A null address is empty;
    line breaks in it become blanks. An empty table gives no archives and an empty manifest. Other columns are left out.
    """
    records = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("binary").alias("payload"))
    return write_archives(with_revisits(records, min_bytes), folder, chunk_bytes)


@query(
    "op1_warc_chunks",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, h, upper(sha1(h)) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
    g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || x[5 * i + 1:5 * i + 5] AS BIGINT)) AS v FROM d)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM g
    """,
)
def op1_warc_chunks(spark, sf_dir):
    manifest = archive_pages(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    out = record_digests(read_archives(manifest, with_data=False))
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
