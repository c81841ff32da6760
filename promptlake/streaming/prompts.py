"""Structured Streaming: new corpus files -> rendered prompt pairs / hash samples -> Parquet.

The reference only iterates lazily over its inputs (no event time, no state), so the stream
jobs here are stateless: file source with batches bounded by bytes, stream-static joins against
the (small) templates and blacklist and the static labels table, a hash-threshold
sample (the threshold gives the same rows as the batch filter), and an ``availableNow`` trigger into
a Parquet sink. ``run_to_parquet`` makes a new sink and checkpoint in every call; the stream that goes
on where it ended, with exact caps, is ``streaming.resume``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_u
from ..operators.templates import attach_templates, nonempty_pairs, render_templates
from ..session import scratch_path
from ..sources.tables import split_of, spread

# Fixed value: bytes of the files that one batch of a stream takes.
BATCH_BYTES = 1 << 30


def corpus_stream(spark: SparkSession, source_dir: str, name: str = "documents", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Stream over table ``name`` of ``source_dir``, a file or a folder of files (explicit schema).

    A batch takes files of ``batch_bytes`` in all, one at least, so that the number of batches, each of
    which reads the static tables, follows the size of the input and not how it was cut into files."""
    path = f"{source_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes)
    # a stream reads folders: of a single file, the folder it lies in is read for that name only
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(source_dir)
    return spread(stream, name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def as_corpus(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("source").alias("dataset"),
        F.col("lang").alias("subset"),
        split_of("doc_id").alias("split"),
        F.col("doc_id").alias("id"),
        "text",
        "n_chars",
    )


def stream_prompt_pairs(stream: DataFrame, labels: DataFrame, templates: DataFrame, blacklist: DataFrame, fields: list[str]) -> DataFrame:
    """Stateless prompt rendering on a stream: static labels (left join), templates
    (fan-out), non-empty filter, anti join with the blacklisted datasets."""
    c = as_corpus(stream).join(labels, "id", "left")
    c = c.join(blacklist.select("dataset").distinct(), "dataset", "left_anti")
    r = render_templates(attach_templates(c, templates), fields, keep=["task", "id"])
    return nonempty_pairs(r).select("task", "id", "inputs", "targets")


def stream_capped_pairs(stream: DataFrame, labels: DataFrame, tasks: DataFrame, fields: list[str]) -> DataFrame:
    """Stateless prompt rendering into the task cache: ``tasks`` (a control table with ``n`` and ``cap``
    per template) is joined, and a row is kept if its seeded hash is below cap / n. The exact cap
    would need state; this keeps about as many, the same ones in every run."""
    t = tasks.withColumn("share", F.col("cap") / F.greatest(F.col("n"), F.lit(1))).drop("n", "cap", "num_templates", "task")
    rows = attach_templates(as_corpus(stream).where(F.col("split") == "train"), t)
    rows = rows.where(hash_u((F.lit(42) + F.col("ordinal")).cast("string"), "id") < F.col("share")).join(labels, "id", "left")
    return nonempty_pairs(render_templates(rows, fields, keep=["task", "template", "id"]))


def stream_sample(stream: DataFrame, rate: float, seed: str = "sample", key: str = "doc_id") -> DataFrame:
    """Rows whose hash is below ``rate`` — the same rows a batch filter keeps."""
    return stream.where(hash_u(seed, key) < F.lit(rate))


def run_to_parquet(df: DataFrame, name: str, partition_cols=()) -> DataFrame:
    """Run a stream with ``availableNow`` into a Parquet sink; returns the sink's rows (none if no row came)."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-checkpoint")
    q = df.writeStream.format("parquet").partitionBy(*partition_cols).option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(out)
