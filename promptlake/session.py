"""Session helpers: building a local session and finding the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Fixed value: the session setting that removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "promptlake") -> SparkSession:
    """Local/test session. On a cluster the session comes from the launcher and this is not used."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see, taken from ``spark.checkpoint.dir``.

    Only when the session has none and runs on one machine (``local`` masters, as in tests) a
    folder under /tmp is created and registered as the checkpoint dir. On a cluster a missing
    setting is an error: each executor would write to its own disk.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    local = tempfile.mkdtemp(prefix="promptlake-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_scratch: list[str] = []  # paths given out by this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for a written intermediate table.

    What is written there stays until ``scratch_run`` ends or ``remove_scratch`` is called: a result
    may read it as long as it is in use."""
    path = f"{shared_dir(spark)}/promptlake/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession, start: int = 0) -> None:
    """Delete the intermediate tables this process has written (from the ``start``-th on). Call it when
    the results that were made from them have been written or collected."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_scratch) > start:
        p = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def scratch_run(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end, also after an error; results must
    have been written or collected by then::

        with scratch_run(spark):
            near_duplicates(docs).write.parquet(out)
    """
    start = len(_scratch)
    try:
        yield
    finally:
        remove_scratch(spark, start)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder and read it back.

    Used where a plan would otherwise be recomputed (e.g. a draw table checked and then
    reused); survives executor loss because the files live in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # what was written stands; its shuffle files are not read again
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)
