"""Deterministic sharded WARC writer and a streaming reader.

Rows are range-sorted by id, each range is written by one task and rolls to a new file when the
compressed size passes ``roll_bytes``. Headers, digests and record ids are made anew from the row
alone and the clock is a parameter, so a second run over the same rows writes the same bytes.
Every record is a gzip member of its own. Files are committed through temporary names and a
manifest (``_files.commit``). Payloads of at least ``min_revisit_bytes`` that occur more than once
are written once, in the record with the largest id; the others become revisit records.

Defined results: a null payload is an empty one; a null url becomes ``urn:page:<id>``, and white
space or control characters in a url are percent-encoded; rows with equal ids are separate records
(all of them responses if the id is the largest of its group); a null id is written as no page
header and read back as null; an empty table gives no files; only id, url and payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._files import NewFile, commit, fs_of, range_shards

NAMESPACE = uuid.UUID("5f6f3c0e-6f0e-5d0e-9d55-0a6b7d1b8f10")
# Fixed value: the profile URI of revisits with equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _safe(url: str | None, page_id) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def _b32(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(row: dict, date: str) -> bytes:
    """One response or revisit record as a gzip member."""
    page_id, payload = row["page_id"], row["payload"] or b""
    revisit = row["first_id"] is not None
    block = HTTP.format(row["payload_bytes"]).encode() + (b"" if revisit else payload)
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", _safe(row["url"], page_id)),
        ("WARC-Date", date),
        ("WARC-Record-ID", record_id(page_id)),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["first_id"])), ("WARC-Refers-To-Target-URI", _safe(row["first_url"], row["first_id"])), ("X-Refers-To-Page-Id", row["first_id"])]
    headers += [
        ("WARC-Payload-Digest", f"sha1:{_b32(row['digest'])}"),
        ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).hexdigest())}"),
        ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(headers, block)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload) with its size and digest and, for revisits, the record they refer to.

    Equal payloads have equal length and SHA-1. The groups of more than one page are aggregated
    with partial sums, so a payload that a third of all pages share costs one row per task, and
    written, so that the join with the pages can split a hot payload."""
    sized = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = (
        sized.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("digest").alias("g_digest"), F.col("payload_bytes").alias("g_bytes"))
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("g_digest", "g_bytes", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    groups = cut_lineage(groups, "payloads")
    joined = sized.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("payload_bytes") == F.col("g_bytes")), "left").drop("g_digest", "g_bytes")
    other = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return (
        joined.withColumn("first_id", F.when(other, F.col("first_id")))
        .withColumn("first_url", F.when(other, F.col("first_url")))
        .withColumn("payload", F.when(~other, F.col("payload")))
    )


_FIELDS = ["shard", "page_id", "url", "payload", "payload_bytes", "digest", "first_id", "first_url"]
_MANIFEST_DDL = "temp string, name string, shard int, seq int, n_records long, bytes long, sha1 string"
_MANIFEST = pa.schema([("temp", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_revisit_bytes: int = 1000,
    roll_bytes: int = 1 << 26,
    shard_bytes: int = 1 << 24,
) -> DataFrame:
    """Write the archives into ``folder``; returns the manifest (name, shard, seq, n_records, bytes, sha1)."""
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    rows = revisits(src, min_revisit_bytes)
    bounds_from = F.coalesce(F.octet_length("payload"), F.lit(0)) + 512
    dealt = range_shards(rows, "page_id", bounds_from, shard_bytes).select(*_FIELDS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, digest, shard, seq, n = None, None, None, 0, 0

        def start():
            nonlocal f, digest, n
            name = f"pages-{shard:06d}-{seq:05d}.warc.gz"
            f, digest, n = NewFile(folder, name), hashlib.sha1(), 0
            info = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
            rid = f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"
            put(_member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", rid), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

        def put(data):
            f.write(data)
            digest.update(data)

        def close():
            nonlocal f, seq
            temp, name, size = f.done()
            row = {"temp": [temp], "name": [name], "shard": [shard], "seq": [seq], "n_records": [n], "bytes": [size], "sha1": [digest.hexdigest()]}
            f, seq = None, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=_MANIFEST)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if row["shard"] != shard:
                        if f:
                            yield close()
                        shard, seq = row["shard"], 0
                    if f is None:
                        start()
                    put(page_record(row, date))
                    n += 1
                    if f.size >= roll_bytes:
                        yield close()
        if f:
            yield close()

    return commit(dealt.mapInArrow(write, _MANIFEST_DDL), folder)


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive; holds one record at a time."""
    data, z = b"", zlib.decompressobj(31)
    parts: list[bytes] = []
    while True:
        data = data or stream.read(size)
        if not data:
            break
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            length = int(headers["Content-Length"])
            if not lines[0].startswith("WARC/") or rest[length:] != b"\r\n\r\n":
                raise ValueError("broken record")
            yield headers, rest[:length]
            parts, z = [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("the archive ends inside a record")


READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of the files of a manifest; digests and lengths are checked on the way.

    A revisit holds no payload: its length and digest are those its headers state."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = fs_of(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                held = 0
                for h, block in records(fs.open_input_stream(posixpath.join(root, name), compression=None)):
                    kind = h["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or str(len(payload)) != h["X-Payload-Length"]):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} in {name} does not match its digest")
                    page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                    row = (page and int(page), int(h["X-Payload-Length"]), digest, kind, to and int(to), h["WARC-Target-URI"])
                    rows.append((*row, payload if kind == "response" else None) if with_payload else row)
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 4096 or held > 1 << 23:
                        yield _batch(rows, with_payload)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    files = cut_lineage(manifest.select("name"), "files")
    ddl = READ_DDL + (", payload binary" if with_payload else "")
    return files.repartition(max(1, files.count()), "name").mapInArrow(read, ddl)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
    return pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])
