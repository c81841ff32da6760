"""Task / mixture cache as partitioned Parquet with incremental (build-only-missing) updates.

Layout: ``{path}/task=<task>/template=<template>/part-*.parquet``, ``_SUCCESS`` marks a complete
table, and a manifest table ``{path}_manifest`` (task, rows) beside it lists what was built, tasks
without any row included. An incremental build anti-joins the requested tasks against the manifest,
builds only the rest and writes them with dynamic partition overwrite, so partitions already
cached are neither rebuilt nor touched. Rows are rebalanced over the partition columns before the
write, so a small task is one file and a large one is split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    return _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _touch_success(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.create(p, True).close()


PARTITIONS = ("task", "template")


def write_cache(df: DataFrame, path: str, partition_cols=PARTITIONS, dynamic: bool = True) -> None:
    """Write (or, with ``dynamic``, replace only the written partitions of) the cache table.

    The job commit makes the partitions visible atomically; only after it returns is the
    ``_SUCCESS`` marker ensured at the table root (dynamic overwrite commits through a staging
    folder and does not leave one there)."""
    cols = [c for c in partition_cols if c in df.columns]
    w = df.hint("rebalance", *cols).write.mode("overwrite").partitionBy(*cols)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
    _touch_success(df.sparkSession, path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}_manifest"


def cached_tasks(spark: SparkSession, path: str, key: str = "task") -> DataFrame:
    """Tasks that were built into a complete cache, with their rows (empty when there is none)."""
    if not is_complete(spark, path) or not _fs_exists(spark, _manifest(path)):
        return spark.createDataFrame([], f"{key} string, rows long")
    return spark.read.parquet(_manifest(path))


def build_incremental(
    spark: SparkSession,
    requested: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    key: str = "task",
) -> DataFrame:
    """Reuse cached tasks, build only the missing ones, return all requested rows from the cache.

    ``requested`` has one row per task name; ``build(missing)`` must return rows (with ``key``)
    for exactly the tasks of ``missing``. The manifest rows of a build are appended after its
    data is committed, so an interrupted build is repeated.
    """
    from ..session import cut_lineage

    requested = cut_lineage(requested.select(key).distinct(), "requested")
    missing = cut_lineage(requested.join(cached_tasks(spark, path, key).select(key), key, "left_anti"), "missing")
    if missing.limit(1).count() > 0:
        write_cache(build(missing), path)
        # only the partitions of the tasks just built are counted, from the files' footers
        new = read_cache(spark, path).join(F.broadcast(missing) if missing.count() <= 100_000 else missing, key, "left_semi")
        rows = new.select(F.col(key).cast("string").alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        built = missing.join(rows, key, "left").select(key, F.coalesce("rows", F.lit(0)).alias("rows"))
        built.write.mode("append").parquet(_manifest(path))
    return read_cache(spark, path).join(requested, key, "left_semi")


def cache_selected(build: Callable[[DataFrame], DataFrame], spark: SparkSession, names: list[str], path: str, key: str = "task") -> DataFrame:
    """Offline caching of a selected task list: the selection goes into the build, so that nothing
    else is computed; write, read back."""
    sel = spark.createDataFrame([(n,) for n in names], f"{key} string")
    write_cache(build(sel), path, dynamic=False)
    return read_cache(spark, path)
