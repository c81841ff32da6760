"""Layouts by key: no exchange in joins on it, one file per bucket, reopened without being written again; scratch is removed."""

import os

from pyspark.sql import functions as F

from promptlake import session
from promptlake.plans.bucket_queries import labelled_layout
from promptlake.session import scratch_path, scratch_run
from promptlake.sources.bucketed import has_layout, laid_out, open_layout
from promptlake.sources.tables import read

from .conftest import SF_SMALL


def test_text_side_of_a_join_is_not_exchanged(spark):
    path = scratch_path(spark, "layouts")
    docs, labels = (laid_out(read(spark, SF_SMALL, t), f"{path}/{t}", "doc_id", 5) for t in ("documents", "labels"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = labelled_layout(docs, labels)._jdf.queryExecution().executedPlan().toString()
        plain = read(spark, SF_SMALL, "documents").join(read(spark, SF_SMALL, "labels"), "doc_id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Exchange hashpartitioning" in plain
    got = {r.id: (r.text, r.quality) for r in labelled_layout(docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in read(spark, SF_SMALL, "labels").collect()}
    assert got == {r.doc_id: (r.text, quality.get(r.doc_id)) for r in read(spark, SF_SMALL, "documents").collect()}


def test_written_once_and_reopened(spark):
    path = scratch_path(spark, "layout")
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 70).alias("k"), F.struct(F.col("id").alias("a b")).alias("s")).repartition(7)
    assert not has_layout(spark, path)
    first = laid_out(rows, path, "k", 4)
    files = sorted(f for f in os.listdir(path.replace("file:", "")) if f.endswith(".parquet"))
    assert len(files) == 4 and has_layout(spark, path)
    second = laid_out(spark.range(1).select(F.col("id").alias("k")), path, "k", 9)  # what is there is not written again
    assert second.columns == ["k", "s"] == open_layout(spark, path).columns and second.count() == 1000 == first.count()
    plan = second.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_scratch_is_removed_at_the_end_of_a_run(spark):
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with scratch_run(spark):
        df = session.cut_lineage(spark.range(5), "inside")
        path = session._scratch[-1].replace("file:", "")
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and os.path.isdir(kept.replace("file:", ""))
