"""WARC archives: a writer with revisit records for equal payloads, and a splittable reader.

Archives hold one gzip member a record. Spark's own file writer puts the members on disk, so a retried
or speculative task leaves no half archive behind. The reader deals byte ranges of the archives to tasks.
A task looks for the gzip magic inside its range, accepts a candidate only if it inflates to a WARC header,
and owns the members that start inside the range, reading past the range's end to finish the last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
_READ = 1 << 18
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP header alone, but digest and length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(df: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Adds _first: the smallest key among rows of equal payload, null where that is the row itself or the payload is under `min_bytes`.

    Only digests that occur again are joined back, from a table in the shared folder, so that a digest
    with a large part of all rows is split by the skew join.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.withColumn("_digest", F.unhex(F.sha2(body, 256)))
    small = F.length(body) < min_bytes
    seen = rows.where(~small).groupBy("_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = common.stage(seen.where("_n > 1").drop("_n"), "warc-again")
    joined = rows.join(again, "_digest", "left").drop("_digest")
    return joined.withColumn("_first", F.when(small | F.col(key).eqNullSafe(F.col("_first")), None).otherwise(F.col("_first")))


def write(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, records_per_file: int = 100_000) -> None:
    """Write a record per row into `path`, a new folder.

    Of rows with equal payloads of at least `min_bytes` bytes that with the smallest key is a response and
    others revisit it; a null payload is the empty one. Rows that repeat the smallest key are responses too, and
    a null key stands last. An empty table gives an empty folder.
    """
    rows = with_originals(df.select(F.col(key), F.col(uri), F.col(payload)), key, payload, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, payload):
            out = []
            for at, to, text, first in zip(*(batch.column(c).to_pylist() for c in (key, uri, payload, "_first")), strict=True):
                member = gzip.compress(record("response" if first is None else "revisit", f"urn:page:{at}", to, date, (text or "").encode(), first if first is None else f"urn:page:{first}"), 6, mtime=0)
                # The writer ends a row with a zero byte, which is the last of the member's size field
                out.append((member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = common.small_batches(rows).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\u0000").option("maxRecordsPerFile", records_per_file).text(path)


class _Bytes:
    """A file's bytes from any position on, through the local file system or one that Arrow knows."""

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            from urllib.parse import unquote

            self.file = open(unquote(re.sub("^file:/+", "/", uri)), "rb")  # noqa: SIM115
        elif "://" not in uri:
            self.file = open(uri, "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(path)

    def at(self, position: int, size: int) -> bytes:
        self.file.seek(position)
        return self.file.read(size)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records in an inflated member."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _header_ok(head: bytes) -> bool:
    return bool(re.match(rb"WARC/\d\.\d\r\n[A-Za-z][\w-]*:", head))


def members(source: _Bytes, start: int, end: int, strict: bool = False) -> Iterator[bytes]:
    """Inflated WARC members of which the first byte lies in [start, end); one that breaks off after a valid header is an error if `strict`."""
    at = start
    buffer, base = b"", start
    while at < end:
        if not (base <= at and at + len(MAGIC) <= base + len(buffer)):
            buffer, base = source.at(at, _READ), at
            if len(buffer) < len(MAGIC):
                return
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = base + len(buffer) - len(MAGIC) + 1
            continue
        at = base + found
        if at >= end:
            return
        whole = _inflate(source, at, buffer[found:], strict)
        if whole is None:
            at += 1
        else:
            data, at = whole
            yield data


def _inflate(source: _Bytes, at: int, data: bytes, strict: bool = False) -> tuple[bytes, int] | None:
    """The member at a position and the position after it; None if the candidate is no WARC member."""
    inflater, parts, checked, size, position = zlib.decompressobj(31), [], False, 0, at
    try:
        while True:
            parts.append(inflater.decompress(data))
            position += len(data)
            size += len(parts[-1])
            if not checked and (size >= 64 or inflater.eof):
                if not _header_ok(b"".join(parts)[:64]):
                    return None
                checked = True
            if inflater.eof:
                return b"".join(parts), position - len(inflater.unused_data)
            data = source.at(position, _READ)
            if not data:
                raise zlib.error("cut off")
    except zlib.error as e:
        if strict and checked:
            raise ValueError(f"the member at byte {at} is damaged: {e}") from e
        return None


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, strict: bool = False) -> DataFrame:
    """One row per record of the archives under `path`.

    record_id, record_type, target_uri, refers_to, payload_bytes and payload_digest of the full payload, digest_ok
    (the block's own digest agrees, or there is no payload to hold it against) and, if asked for, payload (null for a
    revisit) and headers. Bytes that are no WARC member are passed over; a member that breaks off is too, or is an error if `strict`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start")).repartition(common.partitions(files), "path", "start")
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean"
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]
    if with_payload:
        schema += ", payload binary, headers map<string,string>"
        kinds += [pa.binary(), pa.map_(pa.string(), pa.string())]
        names += ["payload", "headers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                with _Bytes(uri) as source:
                    for data in members(source, start, start + split_bytes, strict):
                        for headers, block in parse(data):
                            rows.append(_row(headers, block, with_payload))
                            held += len(block) if with_payload else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return ranges.mapInArrow(run, schema)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    bare = lambda x: x and x.strip("<>")
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, payload = b"", block
    if "application/http" in headers.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        row = (bare(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), bare(headers.get("warc-refers-to")), int(length[1]) if length else None, said, True)
        payload = None
    else:
        own = digest(payload)
        row = (bare(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), bare(headers.get("warc-refers-to")), len(payload), own, said in (None, own))
    return (*row, payload, list(headers.items())) if with_payload else row
