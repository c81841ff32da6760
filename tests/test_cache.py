"""Incremental task cache: cached partitions are reused untouched, only missing tasks are built."""

import os

from pyspark.sql import functions as F

from promptlake.session import scratch_path
from promptlake.sources import cache as C


def _files(path):
    local = path.replace("file:", "")
    out = {}
    for root, _, files in os.walk(local):
        for f in files:
            if f.endswith(".parquet"):
                p = os.path.join(root, f)
                out[p] = os.stat(p).st_mtime_ns
    return out


def test_incremental_build_only_missing(spark):
    rows = spark.createDataFrame([(f"t{i % 4}", i, f"x{i}") for i in range(40)], "task string, id long, v string")
    built = []

    def build(missing):
        names = sorted(r.task for r in missing.collect())
        built.append(names)
        return rows.join(F.broadcast(missing), "task", "left_semi")

    path = scratch_path(spark, "test_cache")
    req1 = spark.createDataFrame([("t0",), ("t1",)], "task string")
    first = C.build_incremental(spark, req1, build, path)
    assert first.count() == 20 and C.is_complete(spark, path)
    before = _files(path)
    req2 = spark.createDataFrame([(f"t{i}",) for i in range(4)], "task string")
    second = C.build_incremental(spark, req2, build, path)
    assert built == [["t0", "t1"], ["t2", "t3"]]
    assert second.count() == 40
    after = _files(path)
    assert all(after.get(p) == m for p, m in before.items())  # t0/t1 files untouched
    third = C.build_incremental(spark, req2, build, path)
    assert len(built) == 2 and third.count() == 40  # nothing left to build
    empty = spark.createDataFrame([("t0",), ("no rows",)], "task string")
    for _ in range(2):  # a task without rows is built once, too
        assert C.build_incremental(spark, empty, build, path).count() == 10
    assert built[2:] == [["no rows"]]


def test_layout_by_task_and_template(spark):
    rows = spark.createDataFrame([("a_x", "x", 1), ("a_y", "y", 2)], "task string, template string, id long")
    path = scratch_path(spark, "test_layout")
    C.write_cache(rows, path, dynamic=False)
    assert {os.path.dirname(p).replace(path.replace("file:", ""), "") for p in _files(path)} == {"/task=a_x/template=x", "/task=a_y/template=y"}


def test_cache_selected(spark):
    rows = spark.createDataFrame([(f"t{i % 4}", i) for i in range(40)], "task string, id long")
    asked = []

    def build(names):
        asked.extend(sorted(r.task for r in names.collect()))
        return rows.join(names, "task", "left_semi")

    out = C.cache_selected(build, spark, ["t1", "t3", "missing"], scratch_path(spark, "test_sel"))
    assert asked == ["missing", "t1", "t3"]
    assert sorted({r.task for r in out.collect()}) == ["t1", "t3"] and out.count() == 20
