"""File sources and sinks: crawl JSON lines (gz), shard manifests, dataset catalog CSV, prompt
text files, prediction lines and metric tables.

Readers always get an explicit schema (no inference pass over the data). Gzip files cannot be
split, so a gz scan yields one task per file; callers repartition afterwards when the files
are few and large. Shards are many small files: tasks write and read them by name through
``pyarrow.fs``, so a file costs no folder of its own, no commit and no listing on the driver.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..session import cut_lineage

CRAWL_SCHEMA = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("url", T.StringType())]
)
CATALOG_SCHEMA = "HF_name string, subset string, task_by_convention string, do_train string, do_eval string, train_size long"

# Shard file name pattern (5-digit zero padded index and count) and the
# fraction of train shards planned per language (languages not listed: all shards).
SHARD_FORMAT = "c4-%s%s.tfrecord-%05d-of-%05d.json.gz"
DOWNLOAD_FRACTION = [("en", 0.2), ("ru", 0.5), ("es", 0.8), ("de", 0.8), ("fr", 0.9)]


def read_crawl_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (optionally .gz) with text, timestamp, url; missing fields become null."""
    df = spark.read.schema(CRAWL_SCHEMA).json(path)
    return df.withColumn("ts", F.try_to_timestamp("timestamp"))


def write_crawl_json(df: DataFrame, path: str) -> None:
    """One gz file per balanced partition: gz cannot be split, so the files are the unit of reading."""
    df.select("text", "timestamp", "url").hint("rebalance").write.mode("overwrite").option("compression", "gzip").json(path)


def shard_manifest(shards: DataFrame) -> DataFrame:
    """(lang, split, n, idx, file) for every shard of a (lang, train, validation) table."""
    long = shards.select(
        "lang",
        F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("train").alias("n")), F.struct(F.lit("validation").alias("split"), F.col("validation").alias("n")))).alias("s"),
    ).select("lang", "s.*")
    long = long.where(F.col("n") > 0)
    ex = long.select("lang", "split", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    suffix = F.when(F.col("split") == "validation", F.lit("-validation")).otherwise(F.lit(""))
    return ex.withColumn("file", F.format_string(SHARD_FORMAT, F.col("lang"), suffix, F.col("idx"), F.col("n")))


def fractional_plan(manifest: DataFrame, fractions: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Train shards to fetch: the first ``min(n, floor(n * f) + 1)`` where a fraction is given,
    all shards otherwise; optionally only the listed languages."""
    m = manifest.where(F.col("split") == "train")
    if languages is not None:
        m = m.where(F.col("lang").isin(languages))
    j = m.join(fractions, "lang", "left")
    k = F.when(F.col("fraction").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.col("n") * F.col("fraction")).cast("long") + 1))
    return j.withColumn("k", k).where(F.col("idx") < F.col("k")).drop("fraction")


# Planned files that a task reads, and bytes of lines it takes up at a time.
FILES_PER_TASK = 32
READ_BYTES = 1 << 20


def _path(root: str, file: str) -> str:
    """Path of a shard: its name in ``root``, also if a language holds a slash."""
    return f"{root.rstrip('/')}/{file.replace('%', '%25').replace('/', '%2F')}"


class _ShardFile:
    """One gz file, written under a name of this attempt and renamed when it is whole."""

    def __init__(self, fs: pafs.FileSystem, root: str, file: str):
        self.fs, self.file, self.path, self.rows = fs, file, _path(root, file), 0
        self.temp = _path(root, f"_tmp-{uuid.uuid4().hex}")
        self.out = fs.open_output_stream(self.temp, compression=None)
        self.gz = gzip.GzipFile(filename="", fileobj=self.out, mode="wb", compresslevel=6, mtime=0)

    def write(self, lines: list[str]) -> None:
        self.gz.write("".join(lines).encode())
        self.rows += len(lines)

    def done(self) -> tuple[str, int]:
        self.gz.close()
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.file, self.rows


def _shard_writer(folder: str):
    """Task: (file, line) rows sorted by file become files; (file, rows) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        table = lambda done: pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "rows": [d[1] for d in done]}, pa.schema([("file", pa.string()), ("rows", pa.int64())]))
        shard = None
        for batch in batches:
            file, line, done = batch.column(0), batch.column(1), []
            changed = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], changed)))[: len(file)].tolist()
            for a, b in zip(first, [*first[1:], len(file)], strict=True):
                name = file[a].as_py()
                if shard is None or shard.file != name:
                    if shard is not None:
                        done.append(shard.done())
                    shard = _ShardFile(fs, root, name)
                shard.write(line.slice(a, b - a).to_pylist())
            yield table(done)
        if shard is not None:
            yield table([shard.done()])

    return write


def write_shards(named: DataFrame, folder: str) -> DataFrame:
    """One gz file of crawl lines per value of ``file``, under that name; returns the written (file, rows).

    The rows of a file meet in one task, next to each other; a file that is written again by a
    repeated attempt holds the same rows and takes the place of the first."""
    line = F.concat(F.to_json(F.struct("text", "timestamp", "url")), F.lit("\n"))
    rows = named.select("file", line.alias("line")).repartition("file").sortWithinPartitions("file")
    return cut_lineage(rows.mapInArrow(_shard_writer(folder), "file string, rows long"), "written_shards")


def _shard_lines(folder: str):
    """Task: file names become the lines of these files, a bounded number of bytes at a time."""

    def whole_lines(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
        rest = b""
        with fs.open_input_stream(path, compression="gzip") as f:
            while block := f.read(READ_BYTES):
                block = rest + block
                cut = block.rfind(b"\n") + 1
                rest = block[cut:]
                if cut:
                    yield block[:cut]
        if rest:
            yield rest + b"\n"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        table = lambda parts: pa.RecordBatch.from_arrays([pa.array([x for x in b"".join(parts).splitlines() if x.strip()], pa.binary())], names=["line"])
        parts, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for lines in whole_lines(fs, _path(root, file)):
                    parts.append(lines)
                    size += len(lines)
                    if size >= READ_BYTES:
                        yield table(parts)
                        parts, size = [], 0
        if parts:
            yield table(parts)

    return read


def read_planned(spark: SparkSession, folder: str, plan: DataFrame) -> DataFrame:
    """Crawl lines of the planned files only: tasks get their names, so no other file is listed or opened."""
    names = cut_lineage(plan.select("file").distinct(), "planned_files")
    tasks = max(1, -(-names.count() // FILES_PER_TASK))
    lines = names.repartition(tasks, "file").mapInArrow(_shard_lines(folder), "line binary")
    df = lines.select(F.from_json(F.col("line").cast("string"), CRAWL_SCHEMA).alias("row")).select("row.*")
    return df.withColumn("ts", F.try_to_timestamp("timestamp"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Dataset catalog CSV; empty cells are nulls."""
    return spark.read.option("header", "true").option("nullValue", "").schema(CATALOG_SCHEMA).csv(path)


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line (a last line without newline is kept whole)."""
    return spark.read.text(path)


def write_prediction_lines(df: DataFrame, path: str, order: str = "id", text: str = "prediction") -> None:
    """Stripped predictions, one per line, in ``order`` (range-partitioned sort, no single task)."""
    df.orderBy(order).select(strip(text).alias("value")).write.mode("overwrite").text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append (split, name, value) rows to the metric table."""
    df.select("split", "name", "value").write.mode("append").parquet(path)
