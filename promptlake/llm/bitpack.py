"""Token ids as fixed-width bit-packed files: every id takes the minimum number of bits.

A file (little-endian) holds: magic, bits, ids per block, number of ids, number of documents;
the blocks (each ``block_ids`` ids, a multiple of 8, so a block is whole bytes; the last one is
padded with zero bits to 8 ids); the byte offset of each block; the id and the first id position
of each document. Blocks unpack with numpy, eight ids at a time, and a document is read by
unpacking only the blocks it lies in.

``write_ids`` range-shards the documents by id, encodes whole texts inside the sorted shards and
rolls files by their number of ids; ``read_ids`` reads the committed files back. A shard's text
crosses one shuffle; ids never do. Memory: one open file (``file_ids`` ids) per task.

Defined results: null or empty texts hold the end id alone; rows with equal ids stay separate rows
in any order; a null id sorts first and is stored as the smallest 64-bit number; an empty table
gives no file and no row; columns other than the id and the text are not read.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._files import NewFile, commit, fs_of, range_shards
from .tokens import encoder

MAGIC = b"PLIDPK01"
HEADER = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block_ids", "<u4"), ("n_ids", "<u8"), ("n_docs", "<u8")])
NULL_ID = -(1 << 63)


def min_bits(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first, padded with zeros to 8 ids."""
    v = np.zeros(-(-len(ids) // 8) * 8, dtype=np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), bits), dtype=np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        x = v[:, j] << np.uint64(shift)
        for k in range(byte, (j * bits + bits - 1) // 8 + 1):
            out[:, k] |= (x & np.uint64(255)).astype(np.uint8)
            x = x >> np.uint64(8)
    return out.tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, bits)
    out = np.empty((len(rows), 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        x = np.zeros(len(rows), dtype=np.uint64)
        for i, k in enumerate(range(byte, (j * bits + bits - 1) // 8 + 1)):
            x |= rows[:, k].astype(np.uint64) << np.uint64(8 * i)
        out[:, j] = ((x >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.reshape(-1)[:n]


class IdFile:
    """Random access to one file."""

    def __init__(self, fs, path: str):
        self.f = fs.open_input_file(path)
        head = np.frombuffer(self.f.read(HEADER.itemsize), dtype=HEADER)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"not an id file: {path}")
        self.bits, self.block_ids, self.n_ids, self.n_docs = (int(head[k]) for k in ("bits", "block_ids", "n_ids", "n_docs"))
        blocks = -(-self.n_ids // self.block_ids)
        tail = 8 * (blocks + 1) + 8 * self.n_docs + 8 * (self.n_docs + 1)
        raw = np.frombuffer(self.f.read_at(tail, self.f.size() - tail), dtype="<i8")
        self.block_at, self.doc_id, self.doc_at = np.split(raw, [blocks + 1, blocks + 1 + self.n_docs])

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the file; touches only their blocks."""
        if a >= b:
            return np.empty(0, dtype=np.uint32)
        lo, hi = a // self.block_ids, -(-b // self.block_ids)
        data = self.f.read_at(int(self.block_at[hi] - self.block_at[lo]), int(self.block_at[lo]))
        ids = unpack(data, self.bits, min(hi * self.block_ids, self.n_ids) - lo * self.block_ids)
        return ids[a - lo * self.block_ids : b - lo * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.doc_at[i]), int(self.doc_at[i + 1]))


def _file_bytes(docs: list[int], sizes: list[int], ids: np.ndarray, bits: int, block_ids: int) -> Iterator[bytes]:
    head = np.array([(MAGIC, bits, block_ids, len(ids), len(docs))], dtype=HEADER)
    at = [HEADER.itemsize]
    yield head.tobytes()
    for a in range(0, len(ids), block_ids):
        data = pack(ids[a : a + block_ids], bits)
        at.append(at[-1] + len(data))
        yield data
    yield np.array(at, dtype="<i8").tobytes()
    yield np.array(docs, dtype="<i8").tobytes()
    yield np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes()


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    kind: str,
    vocab: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 4096,
    file_ids: int = 1 << 23,
    shard_bytes: int = 1 << 25,
) -> DataFrame:
    """Write the files; returns the manifest (name, shard, seq, n_ids, n_docs, bytes, base).

    ``base`` is the number of ids in all files before it, in ascending order of the documents' ids."""
    if block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8")
    bits = min_bits(vocab)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = range_shards(src, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, shard_bytes).select("shard", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, kind)
        shard, seq, ids, sizes, docs_, held = None, 0, [], [], [], 0

        def flush():
            nonlocal seq, ids, sizes, docs_, held
            f = NewFile(folder, f"ids-{shard:06d}-{seq:05d}.bin")
            flat = np.concatenate(ids)
            for part in _file_bytes(docs_, sizes, flat, bits, block_ids):
                f.write(part)
            temp, name, size = f.done()
            row = {"temp": [temp], "name": [name], "shard": [shard], "seq": [seq], "n_ids": [len(flat)], "n_docs": [len(docs_)], "bytes": [size]}
            seq, ids, sizes, docs_, held = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=_MANIFEST)

        for batch in batches:
            shards = batch.column(0).to_numpy()
            keys = batch.column(1).fill_null(NULL_ID).to_numpy()
            for a, b, off, flat in encode(batch.column(2)):
                for i in range(a, b):
                    if shards[i] != shard:
                        if docs_:
                            yield flush()
                        shard, seq = int(shards[i]), 0
                    own = flat[off[i - a] : off[i - a + 1]]
                    ids.append(np.append(own, np.uint32(end_id)))
                    sizes.append(len(own) + 1)
                    docs_.append(int(keys[i]))
                    held += len(own) + 1
                    if held >= file_ids:
                        yield flush()
        if docs_:
            yield flush()

    manifest = commit(dealt.mapInArrow(write, _MANIFEST_DDL), folder)
    by_shard = manifest.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # one row per shard, MAX_SHARDS at most
    before = by_shard.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("within", within).join(before, "shard").withColumn("base", F.col("before") + F.col("within")).drop("before", "within")


_MANIFEST = pa.schema([("temp", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("bytes", pa.int64())])
_MANIFEST_DDL = "temp string, name string, shard int, seq int, n_ids long, n_docs long, bytes long"
READ_DOCS = 4096


def read_ids(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids before it in all files), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = fs_of(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = IdFile(fs, posixpath.join(root, name))
                for a in range(0, f.n_docs, READ_DOCS):
                    b = min(a + READ_DOCS, f.n_docs)
                    at = f.doc_at[a : b + 1] - f.doc_at[a]
                    ids = f.read(int(f.doc_at[a]), int(f.doc_at[b])).astype("<u4")
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [pa.array(f.doc_id[a:b]), pa.array(f.doc_at[a:b] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # one row per file: a task reads a few files, however few partitions the manifest has
    files = cut_lineage(manifest.select("name", "base"), "files")
    n = files.count()
    out = files.repartition(max(1, n), "name").mapInArrow(read, ddl)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NULL_ID), F.col("doc_id")))
