"""Range shards and file sets: temporary names first, a manifest, then final names.

Tasks write under the folder that every executor sees (``spark.checkpoint.dir``, or a folder the
caller names) through ``pyarrow.fs``, so the folder may be local, on HDFS or in an object store.
A file first gets a name of its own per attempt; the rows a task returns name the files of the
attempt that succeeded. Those rows are the manifest; only files in it get their final names, so
what lost or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_SHARDS = 50_000  # bound of the split points held by the driver; files roll inside a shard
SAMPLE_PER_SHARD = 20


def fs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def byte_cuts(keys: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """Keys that cut a sample of rows into ``shards`` ranges of about equally many bytes."""
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(sizes[order])
    at = np.searchsorted(upto, upto[-1] / shards * np.arange(1, shards)) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[order][np.minimum(at, len(keys) - 1)] if len(keys) else keys


def range_shards(df: DataFrame, key: str, size, target_bytes: int) -> DataFrame:
    """``df`` dealt and sorted by ranges of ``key``, with its range number in column ``shard``.

    The number of ranges follows the total of ``size`` (a Column, bytes per row). The split points
    come from a hash sample of the keys with their sizes (at most about SAMPLE_PER_SHARD *
    MAX_SHARDS of them), so ranges hold equally many bytes, not rows, and depend on the rows alone
    and not on the partitioning: a second run cuts at the same keys. Each range is a partition of
    its own, not dealt by a hash of its number, which would put several into one task.
    """
    total = df.agg(F.sum(size).alias("b"), F.count(key).alias("n")).first()
    shards = int(min(max(1, -(-(total["b"] or 0) // target_bytes)), MAX_SHARDS))
    every = max(1, (total["n"] or 0) // (SAMPLE_PER_SHARD * shards))
    picked = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).groupBy(key).agg(F.sum(size).alias("b"))
    sample = picked.collect() if shards > 1 else []
    cuts = byte_cuts(np.array([r[0] for r in sample], dtype=np.int64), np.array([(r["b"] or 0) + 1 for r in sample], dtype=np.int64), shards)

    @F.pandas_udf(T.IntegerType())
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    numbered = df.withColumn("shard", shard_of(F.coalesce(F.col(key), F.lit(-(1 << 63)))))
    return numbered.repartitionById(shards, "shard").sortWithinPartitions("shard", key)


class NewFile:
    """One output file under a temporary name; ``done`` closes it and returns its manifest fields."""

    def __init__(self, folder: str, name: str):
        self.fs, root = fs_of(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = name
        self.temp = f"_tmp-{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(posixpath.join(root, self.temp), compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def done(self) -> tuple[str, str, int]:
        self.out.close()
        return self.temp, self.final, self.size


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of ``manifest`` (temp, name, ...) their final names; returns the written manifest.

    The manifest is written first, so the files it names belong to one successful attempt each.
    Renaming may be repeated: a file that already has its final name is left alone.
    """
    manifest = cut_lineage(manifest, "manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = fs_of(folder)
        for b in batches:
            for temp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                src, dst = posixpath.join(root, temp), posixpath.join(root, name)
                if fs.get_file_info(src).type != pafs.FileType.NotFound:
                    fs.move(src, dst)
                elif fs.get_file_info(dst).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(dst)
            yield b.select(["name"])

    moved = manifest.select("temp", "name").mapInArrow(rename, "name string")
    return manifest.join(cut_lineage(moved, "committed"), "name").drop("temp")
