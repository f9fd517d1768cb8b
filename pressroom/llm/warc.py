"""WARC archives: distributed writing with revisit records, and sequential reading."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_at, replacing
from .scratch import keep, new_folder

CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{digest}>"


def _header_value(text: str) -> str:
    """Control characters would end a header line: they are percent-encoded, as in a URI."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, in one gzip member: a response with its payload, or a revisit with HTTP headers only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(f, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file one after another, each as pieces of at most chunk bytes or so.

    A member's pieces must be used up before the next member is asked for.
    """
    rest = f.read(chunk)

    def pieces() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or rest or f.read(chunk)
            if not z.unconsumed_tail:
                rest = b""
            if not data:
                raise ValueError("the archive ends within a record")
            if out := z.decompress(data, chunk):
                yield out
        rest = z.unused_data

    while rest or (rest := f.read(chunk)):
        yield pieces()


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_records(f, payloads: bool = True, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of an open archive in order, framed by Content-Length and checked by their digests.

    A wrong digest, a short block or bytes after a record raise ValueError.
    """
    for member in members(f, chunk):
        head = b""
        for piece in member:
            head += piece
            if b"\r\n\r\n" in head:
                break
        top, found, body = head.partition(b"\r\n\r\n")
        version, headers = _headers(top)
        if not found or not version.startswith("WARC/"):
            raise ValueError("a member doesn't begin with a WARC record")
        length = int(headers["content-length"])
        block_digest, payload_digest = hashlib.sha1(), hashlib.sha1()
        http, payload, seen, tail = b"", [], 0, b""

        def take(data: bytes) -> None:
            nonlocal http, seen, tail
            inside = data[: max(0, length - seen)]
            tail += data[len(inside) :]
            seen += len(inside)
            block_digest.update(inside)
            if b"\r\n\r\n" not in http:
                http += inside
                top, found, inside = http.partition(b"\r\n\r\n")
                if not found:
                    return
                http = top + found
            payload_digest.update(inside)
            if payloads:
                payload.append(inside)

        take(body)
        for piece in member:
            take(piece)
        if seen != length or tail != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        named = lambda name: headers[name].removeprefix("sha1:")
        if base64.b32encode(block_digest.digest()).decode() != named("warc-block-digest"):
            raise ValueError("a block doesn't have its digest")
        kind = headers["warc-type"]
        if kind == "response" and base64.b32encode(payload_digest.digest()).decode() != named("warc-payload-digest"):
            raise ValueError("a payload doesn't have its digest")
        yield {
            "page_id": _page(headers["warc-record-id"]),
            "url": headers.get("warc-target-uri"),
            "payload_bytes": int(_headers(http[:-4])[1]["content-length"]),
            "payload_digest": named("warc-payload-digest"),
            "record_type": kind,
            "refers_to": _page(headers.get("warc-refers-to")),
            "payload": b"".join(payload) if kind == "response" and payloads else None,
        }


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        uri, n = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with replacing(uri) as write:
            while batch is not None:
                for page_id, url, html, refers_to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), batch.column("refers_to").to_pylist()):
                    write(record(page_id, url, html.as_buffer().to_pybytes() if html.is_valid else b"", refers_to, date))
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["uri", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages to .warc.gz files in folder; returns the files: uri, records.

    The payload is the html in UTF-8 (null: empty).  Of records with equal payloads of at least
    min_bytes, that with the largest id is a response and the others are revisits of it; smaller
    payloads are all responses.  Payloads are grouped by SHA-1 and length; only groups of
    several take part in the join, and a group of any size is spread over tasks.

    A row with a null id is never revisited, but may revisit.  Rows that repeat the largest
    id of a group are all responses.  A null url is left out.  No rows give no files.
    """
    html = F.col(html_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.coalesce(html, F.lit("")).cast("binary")).alias("sha1"), F.coalesce(F.octet_length(html), F.lit(0)).alias("size"))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    groups = keep(groups.select("sha1", "size", "kept"), "payloads")
    records = rows.join(groups, ["sha1", "size"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")))
    return keep(records.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, date), "uri string, records long"), "archives")


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROW.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, size = [], 0
                with read_at(uri) as f:
                    for r in read_records(f, payloads):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > 1 << 22:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_warc(files: DataFrame, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """Records of the archives named in the column uri of files, one task or more, a file whole in one task.

    Columns: page_id, url, payload_bytes, payload_digest (bare base32 SHA-1 of the full payload),
    record_type, refers_to, payload (of responses, if asked for).
    """
    spread = files.select("uri").repartition(tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(_read(payloads), _ROW)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
