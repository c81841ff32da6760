"""A stream into the task cache that goes on where it ended, with exact caps.

Sink and checkpoint belong together and are the caller's: a second run with both reads only files
that no batch has read. Each batch is one folder of data (``data/batch=<id>``, by task and template)
and, after it, one folder of the manifest (``manifest/batch=<id>``: per task the rows admitted and
written). Only batches of the manifest are read back. Spark repeats a batch that ended before its
commit under the same id with the same files, so its folders are replaced and nothing is doubled,
whether it was lost in the data, between data and manifest, or after both.

The cap is exact: of each task's rows, in order of arrival (batch, then id), the first ``cap`` are
admitted. Its state is the manifest: what earlier batches admitted is added up per task, tasks that
are full take part no more, and the rows of the others are ranked by ``ordered_rank``. Unlike state
per key in a stateful operator, a task that holds most rows is ranked by many tasks, and only ids
are. Labels are reduced to the batch's ids before they are joined; texts come last.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_rank
from ..operators.ranking import broadcast_checked
from ..operators.templates import nonempty_pairs, render_templates
from ..session import cut_lineage
from ..sources.cache import PARTITIONS, _fs_exists
from .prompts import as_corpus

MANIFEST = "task string, template string, admitted long, rows long"


def _path_of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """A sink takes batches of one checkpoint only: with another, batch ids would start anew over old ones."""
    marker = f"{path}/checkpoint.json"
    if _fs_exists(spark, marker):
        held = spark.read.text(marker, wholetext=True).first()["value"]
        if json.loads(held)["checkpoint"] != checkpoint:
            raise ValueError(f"{path} was filled from another checkpoint")
        return
    fs, p = _path_of(spark, marker)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"checkpoint": checkpoint}).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(task, template, admitted, rows, batch) of the batches that are whole."""
    if not _fs_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], f"{MANIFEST}, batch long")
    return spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{path}/manifest")


def read_stream_cache(spark: SparkSession, path: str) -> DataFrame:
    """All rows of whole batches."""
    batches = broadcast_checked(manifest(spark, path).select("batch").distinct(), "batches")
    return spark.read.parquet(f"{path}/data").withColumn("batch", F.col("batch").cast("long")).join(batches, "batch", "left_semi")


def _write_manifest(rows: DataFrame, path: str, batch: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def _admitted(docs: DataFrame, tasks: DataFrame, path: str, batch: int) -> DataFrame:
    """(dataset, subset, template, task, id) of the rows that the caps let in, written."""
    spark = docs.sparkSession
    taken = manifest(spark, path).where(F.col("batch") < batch).groupBy("task").agg(F.sum("admitted").alias("taken"))
    left = tasks.join(taken, "task", "left").withColumn("left", F.col("cap") - F.coalesce("taken", F.lit(0))).where("left > 0")
    left = broadcast_checked(left.select("dataset", "subset", "template", "task", "left"), "open_tasks")
    ranked = ordered_rank(docs.select("dataset", "subset", "id").join(left, ["dataset", "subset"]), "task", "id", "rn")
    return cut_lineage(ranked.where(F.col("rn") <= F.col("left")).select("dataset", "subset", "template", "task", "id"), "admitted")


def _take_batch(docs: DataFrame, batch: int, *, tasks: DataFrame, labels: DataFrame, path: str, fields: list[str]) -> None:
    docs = as_corpus(docs).where(F.col("split") == "train")
    admitted = _admitted(docs, tasks, path, batch)
    labelled = admitted.join(labels.join(admitted.select("id"), "id", "left_semi"), "id", "left")
    rows = docs.join(broadcast_checked(labelled, "batch_rows"), ["dataset", "subset", "id"]).join(tasks.select("task", "jinja", "tpl_choices"), "task")
    out = nonempty_pairs(render_templates(rows, fields, keep=[*PARTITIONS, "id"])).drop("answer_choices")
    data = f"{path}/data/batch={batch}"
    out.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(data)
    counts = admitted.groupBy("task", "template").agg(F.count(F.lit(1)).alias("admitted"))
    if out.sparkSession.read.schema(out.schema).parquet(data).limit(1).count():
        written = out.sparkSession.read.schema(out.schema).parquet(data).groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.join(written, "task", "left").select("task", "template", "admitted", F.coalesce("rows", F.lit(0)).alias("rows"))
    else:
        counts = counts.withColumn("rows", F.lit(0).cast("long"))
    _write_manifest(counts, path, batch)


def run_into_cache(stream: DataFrame, tasks: DataFrame, labels: DataFrame, path: str, checkpoint: str, fields: list[str]) -> dict[str, int]:
    """Take all files that no batch of ``checkpoint`` has read into the cache at ``path``.

    ``tasks``: dataset, subset, template, task, cap, jinja, tpl_choices; ``labels``: id and the label
    fields. Returns how many batches were run and rows were read."""
    spark = stream.sparkSession
    path, checkpoint = path.rstrip("/"), checkpoint.rstrip("/")
    _claim(spark, path, checkpoint)
    tasks = broadcast_checked(tasks, "stream_tasks")
    ran = {"batches": 0, "rows": 0}

    def take(docs: DataFrame, batch: int) -> None:
        _take_batch(docs, batch, tasks=tasks, labels=labels, path=path, fields=fields)
        ran["batches"] += 1
        ran["rows"] += docs.count()  # from the footers

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return ran


def feed_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files that arrive anywhere under ``folder``."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)
