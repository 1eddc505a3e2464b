"""WARC archives: written one gzip member per record, read back by byte ranges.

Reading is splittable though gzip is not: a task scans its range for the gzip magic,
takes a candidate for a record only if it inflates to a WARC version line with complete
headers, and owns the records that start inside its range, wherever they end. After a
record the next one starts where its member ended, so bytes inside a payload that look
like a member are never tried.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm.common import batch_of, map_batches, stored, utf8

MAGIC = b"\x1f\x8b\x08"
#: A file is closed by the record that takes it over this size; a task reads ranges of SPLIT bytes, CHUNK at a time.
FILE_BYTES, SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20, 1 << 20
#: Ranges a task reads; compressed bytes first tried as a member.
RANGES_PER_TASK, STEP_BYTES = 2, 1 << 12
SALTS = 32
VERSION = b"WARC/1.1\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: control characters would end the line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(value))


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit has the headers of its response, with the
    payload's length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else _clean(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else _clean(refers_to)}>"))
    else:
        block += payload
    headers.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def parsed(data: bytes) -> Record | None:
    """The record in the bytes of one member; None if it is no WARC record."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if "warc-type" not in headers or not size.isdigit() or int(size) > len(rest):
        return None
    return Record(headers, rest[: int(size)])


class _Bytes:
    """A file read forward in chunks; what lies before a place may be dropped."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, bytearray()
        file.seek(start)

    def more(self) -> bool:
        chunk = self.file.read(min(CHUNK_BYTES, self.size - self.at - len(self.data)))
        self.data += chunk
        return bool(chunk)

    def drop(self, place: int) -> None:
        del self.data[: place - self.at]
        self.at = place


def _member(source: _Bytes, place: int) -> tuple[Record, int] | None:
    """The record of the member at ``place`` and where the member ends. Headers may have any
    length: what begins as a record is inflated to the member's end."""
    unpack, out, at = zlib.decompressobj(31), [], place - source.at
    start, checked, step = b"", False, STEP_BYTES
    while True:
        if at >= len(source.data) and not source.more():
            return None
        try:
            with memoryview(source.data) as held:
                part = held[at : at + step]
                at += len(part)
                out.append(unpack.decompress(part))
                part.release()
        except zlib.error:
            return None
        # In growing steps: what follows a member is copied, and should be little.
        at, step = at - len(unpack.unused_data), min(2 * step, CHUNK_BYTES)
        if not checked:
            start += out[-1][:5]
            if not b"WARC/".startswith(start[:5]):
                return None
            checked = len(start) >= 5
        if unpack.eof:
            found = parsed(b"".join(out))
            return None if found is None else (found, source.at + at)


def records_in(file, start: int, stop: int, size: int) -> Iterator[Record]:
    """The records that start in ``[start, stop)`` of an open file of ``size`` bytes."""
    source, place = _Bytes(file, start, size), start
    while place < stop:
        at = source.data.find(MAGIC, place - source.at)
        if at < 0:
            # Keep what may be the beginning of a magic cut in two.
            place = max(place, source.at + len(source.data) - len(MAGIC) + 1)
            source.drop(place)
            if not source.more():
                return
            continue
        place = source.at + at
        if place >= stop:
            return
        source.drop(place)
        found = _member(source, place)
        if found is None:
            place += 1
            continue
        yield found[0]
        place = found[1]
        source.drop(place)


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def _uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, so that tasks can open what lies in it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for every row below ``folder``; returns the manifest ``(file, bytes, records)``.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the
    smallest id is the response and the others revisit it. Rows that share the smallest id
    are all responses; a null id is never the smallest, and where no other id has the
    payload, all are responses. A null html is the empty payload, a null url leaves its
    header out. An empty table writes no file.

    Payloads meet by digest and length only; a payload with very many copies is counted
    before the shuffle and its rows are split over tasks. Files get names of their own in
    every attempt of a task, and only files of attempts that succeeded are in the manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = (
        rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").drop("copies").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    )
    salted = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(id, url), {SALTS}) as int)"))
    marked = salted.join(first, ["digest", "n", "salt"], "left").select("id", "url", "html", "first")
    uri = _uri(spark, folder)
    system, path = _open(uri)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(uri)
        out, name, size, n = None, "", 0, 0
        schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            ids, urls, firsts = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for page_id, url, html, least in zip(ids, urls, utf8(batch.column(2)), firsts):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, html, least, revisit=least is not None and page_id != least)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield batch_of(schema, [f"{uri}/{name}"], [size], [n])
        if out is not None:
            out.close()
            yield batch_of(schema, [f"{uri}/{name}"], [size], [n])

    return stored(map_batches(marked, run, "file string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files of a manifest ``(file, bytes)``:
    ``(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload)``.

    Ids are strings here, as in the headers (empty: null). The digest is checked against
    the payload where the record has one; a difference is an error. A revisit's payload is
    null and its length that of its headers.
    """
    ranges = manifest.select("file", "bytes", F.explode(
        F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    # A fixed number of partitions, which the engine does not merge however few bytes the
    # ranges themselves take: a task reads RANGES_PER_TASK of them.
    total = manifest.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(max(1, -(-int(total) // RANGES_PER_TASK)), F.col("file"), F.col("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _open(file)
                rows, held = [], 0
                with system.open_input_file(path) as opened:
                    for r in records_in(opened, start, min(size, start + split_bytes), size):
                        rows.append(_row(r))
                        held += len(r.block)
                        if held > CHUNK_BYTES * 16:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        *((c, pa.string()) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest")),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])
    return map_batches(ranges, run, (
        "page_id string, url string, record_type string, refers_to string, payload_digest string,"
        " payload_bytes bigint, payload binary"))


def _row(r: Record) -> dict:
    h = r.headers
    http, _, body = r.block.partition(b"\r\n\r\n")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = h["warc-type"] == "revisit"
    size = len(body)
    if revisit:
        lengths = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths else None
    elif digest != sha1_base32(body):
        raise ValueError(f"payload of {h.get('warc-record-id')} does not match its digest")
    urn = lambda v: (v or "").removeprefix("<urn:page:").removesuffix(">") or None
    return {
        "page_id": urn(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
        "refers_to": urn(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size,
        "payload": None if revisit else body,
    }
