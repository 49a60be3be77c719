"""WARC archives: written by tasks, read back and assembled into captures.

A capture has a response (or a revisit of an earlier equal payload), a request
and a metadata record; the latter two name the first in WARC-Concurrent-To.
Records are gzip members of their own. Reading parses every record, joins the
records of a capture through that identifier, and revisits to the response
they refer to, and gives one nested row per capture.

Of equal payloads of at least ``least`` bytes the row with the smallest id is
the response and the others revisit it. Null payloads are empty; null URLs
become ``urn:`` names and read back as null; null ids sort first; rows that
repeat an id are numbered, and each is its own capture. Only digests and ids
meet by payload (a hot payload is pre-aggregated, its rows' join is split by
adaptive execution); bodies are dealt by the row's own key. A payload is in
memory whole, with its compressed record; an empty table gives no files and no
rows; columns other than the three are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_folder, file_system, unique_ids, written

_BREAKS = re.compile(r"[\x00-\x20\x7f]")
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def _urn(kind: str, key: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind}:{key}'.encode()).digest())}>"


def _record(headers: list[tuple[str, str]], body: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def capture_records(key: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 1) -> bytes:
    """The three gzip members of one capture."""
    target = "urn:page:" + str(page_id) if url is None else _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url)
    own = _urn("response", key)
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha256:" + digest)]
    if refers_to is None:
        first = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *http], head + payload, level)
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        first = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, profile, ("WARC-Refers-To", _urn("response", refers_to)), *http], head, level)
    ask = f"GET {target} HTTP/1.1\r\n\r\n".encode()
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], ask, level)
    fields = f"page-id: {'' if page_id is None else page_id}\r\nhas-url: {int(url is not None)}\r\n".encode()
    meta = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields, level)
    return first + request + meta


def roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``key`` (one per row), ``page_id``, ``digest`` and ``refers_to``: the key
    of the response that a row revisits, or null."""
    rows = pages.select("key", "page_id", F.sha2("payload", 256).alias("digest"), (F.length("payload") >= least).alias("large"))
    rows = written(rows, "payload-digests")
    first = F.min_by(F.struct("key"), F.struct(F.col("page_id").isNotNull(), "page_id", "key")).alias("first")
    groups = rows.where("large").groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first.key")
    groups = groups.select(F.col("digest").alias("d"), F.col("key").alias("first"))
    joined = rows.join(groups, (F.col("digest") == F.col("d")) & F.col("large"), "left")
    return joined.select("key", "digest", F.when(F.col("first") != F.col("key"), F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, file_bytes: int = 32 << 20, date: str = "2025-01-01T00:00:00Z"
) -> DataFrame:
    """Writes all pages and returns the archive files: ``path``, ``folder``."""
    folder = file_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    # a key per row that every pass sees alike: the id, or numbers in a copy if ids are missing or repeated
    if unique_ids(pages, id_col):
        rows = rows.withColumn("key", F.col("page_id"))
    else:
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "keyed-pages")
    joined = rows.join(roles(rows, least), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, size, path = None, 0, ""
        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(path)
                    size += out.write(capture_records(*row, date))
                    if size >= file_bytes:
                        out.close()
                        out, size = None, 0
                        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    made = joined.select("key", "page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string")
    return written(made, "warc-files").withColumn("folder", F.lit(folder))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of every record of a gzip archive."""
    unzip, data = zlib.decompressobj(31), bytearray()
    chunk = b""
    while True:
        chunk = chunk or stream.read(1 << 16)
        if not chunk:
            if data:
                raise ValueError("archive cut short")
            return
        data += unzip.decompress(chunk)
        chunk = b""
        if unzip.eof:
            chunk = unzip.unused_data
            unzip = zlib.decompressobj(31)
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            data = bytearray()


def read_records(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record; ``digest`` and ``payload_bytes`` are those of the
    payload that the record holds, for a revisit the digest it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        rows, size = [], 0
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with file_system(folder)[0].open_input_stream(path) as stream:
                    for h, body in parse(stream):
                        kind, payload, digest, n, fields = h["WARC-Type"], None, None, None, []
                        if kind == "response":
                            payload = body.partition(b"\r\n\r\n")[2]
                            digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
                            if h["WARC-Payload-Digest"] != "sha256:" + digest:
                                raise ValueError(f"damaged payload in {path}")
                        elif kind == "revisit":
                            digest = h["WARC-Payload-Digest"].partition(":")[2]
                        elif kind == "metadata":
                            fields = [tuple(x.split(": ", 1)) for x in body.decode().split("\r\n") if x]
                        size += len(payload or b"") + 500
                        rows.append((kind, h["WARC-Record-ID"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h["WARC-Target-URI"], digest, n, payload if payloads else None, fields))
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "folder").repartition(max(1, files.count())).mapInArrow(run, RECORD)


def captures(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per capture: ``page_id``, ``url``, and the structs ``response``
    (record id, record type, digest, payload bytes, payload, refers_to as the
    record id and page of the response), ``request`` and ``metadata``."""
    records = read_records(files, payloads)
    main = F.col("kind").isin("response", "revisit")
    one = lambda kind, *cols: F.max(F.when(kind, F.struct(*cols)))  # noqa: E731  a capture has one of each
    held = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        one(main, F.col("kind").alias("record_type"), "record_id", "uri", "digest", "payload_bytes", "payload", "refers_to").alias("response"),
        one(F.col("kind") == "request", "record_id", "concurrent_to").alias("request"),
        # a map cannot be compared: its entries can
        one(F.col("kind") == "metadata", "record_id", "concurrent_to", F.map_entries("fields").alias("fields")).alias("metadata"),
    )
    field = lambda name: F.element_at(F.map_from_entries(F.col("metadata.fields")), name)
    held = held.withColumn("page_id", F.nullif(field("page-id"), F.lit("")).cast("long")).withColumn("url", F.when(field("has-url") == "1", F.col("response.uri")))
    held = written(held, "captures")
    origin = held.where("response.record_type = 'response'").select(F.col("capture").alias("_of"), F.struct("page_id", F.col("response.payload_bytes").alias("payload_bytes")).alias("origin"))
    return held.join(origin, F.col("response.refers_to") == F.col("_of"), "left").drop("_of")


def digests(files: DataFrame) -> DataFrame:
    """What the archives say of each page, without the payloads."""
    c = captures(files, payloads=False)
    return c.select(
        "page_id",
        F.coalesce("response.payload_bytes", "origin.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("origin.page_id").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= 100
"""
