"""The resumable stream: later runs read later files only, lost batches are not doubled, caps are exact."""

import pytest
from pyspark.sql import functions as F

from promptlake.session import scratch_path
from promptlake.sources.tables import corpus, read
from promptlake.streaming import resume as R

from .conftest import SF_SMALL

CAP = 7


def _setup(spark):
    docs = read(spark, SF_SMALL, "documents")
    labels = read(spark, SF_SMALL, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    from promptlake.plans.prompts import CORPUS_PROMPTS, prompt_tasks

    tasks = prompt_tasks(corpus(spark, SF_SMALL), CORPUS_PROMPTS).withColumn("cap", F.lit(CAP))
    tasks = tasks.withColumnRenamed("name", "template").withColumnRenamed("answer_choices", "tpl_choices").cache()
    return docs, labels, tasks


def _expected(spark):
    """First ids of each (dataset, subset) among the training rows, by id: the batch build."""
    rows = corpus(spark, SF_SMALL).where("split = 'train'").select("dataset", "subset", "id").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.id):
        by.setdefault((r.dataset, r.subset), []).append(r.id)
    return {i for ids in by.values() for i in ids[:CAP]}


def test_resumes_with_new_files_only_and_exact_caps(spark):
    from promptlake.plans.prompts import FIELDS

    docs, labels, tasks = _setup(spark)
    feed, path, checkpoint = (scratch_path(spark, f"t-{x}") for x in ("feed", "cache", "ckpt"))
    cut = docs.approxQuantile("doc_id", [0.4, 0.8], 0.0)
    parts = [docs.where(F.col("doc_id") <= cut[0]), docs.where((F.col("doc_id") > cut[0]) & (F.col("doc_id") <= cut[1])), docs.where(F.col("doc_id") > cut[1])]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{feed}/{k}")
        ran = R.run_into_cache(R.feed_stream(spark, feed, docs.schema), tasks, labels, path, checkpoint, FIELDS)
        assert ran == {"batches": 1, "rows": part.count()}
    assert R.run_into_cache(R.feed_stream(spark, feed, docs.schema), tasks, labels, path, checkpoint, FIELDS) == {"batches": 0, "rows": 0}
    out = R.read_stream_cache(spark, path)
    assert {r.id for r in out.select("id").collect()} <= _expected(spark) and out.count() == out.select("task", "id").distinct().count()
    admitted = R.manifest(spark, path).groupBy("task").agg(F.sum("admitted").alias("n"), F.sum("rows").alias("rows"))
    assert all(r.n <= CAP for r in admitted.collect()) and admitted.agg(F.sum("n")).first()[0] == 2 * len(_expected(spark))
    assert admitted.agg(F.sum("rows")).first()[0] == out.count()
    with pytest.raises(ValueError):
        R.run_into_cache(R.feed_stream(spark, feed, docs.schema), tasks, labels, path, scratch_path(spark, "other"), FIELDS)


@pytest.mark.parametrize("late", [False, True])
def test_a_lost_batch_is_not_doubled(spark, monkeypatch, late):
    """Killed between data and manifest, or after the manifest and before the commit of the batch."""
    from promptlake.plans.prompts import FIELDS

    docs, labels, tasks = _setup(spark)
    feed, path, checkpoint = (scratch_path(spark, f"l-{x}") for x in ("feed", "cache", "ckpt"))
    docs.repartitionByRange(2, "doc_id").write.parquet(feed)
    write, calls = R._write_manifest, []

    def dies_once(rows, at, batch):
        calls.append(batch)
        if late or len(calls) > 1:
            write(rows, at, batch)
        if len(calls) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(R, "_write_manifest", dies_once)
    with pytest.raises(Exception, match="lost"):
        R.run_into_cache(R.feed_stream(spark, feed, docs.schema), tasks, labels, path, checkpoint, FIELDS)
    if not late:
        assert R.manifest(spark, path).count() == 0 and R.read_stream_cache(spark, path).count() == 0  # data without a manifest is not read
    R.run_into_cache(R.feed_stream(spark, feed, docs.schema), tasks, labels, path, checkpoint, FIELDS)
    assert calls[:2] == [0, 0]
    out = R.read_stream_cache(spark, path)
    assert out.count() == out.select("task", "id").distinct().count() > 0
    assert {r.id for r in out.select("id").collect()} <= _expected(spark)
    assert R.manifest(spark, path).agg(F.sum("admitted")).first()[0] == 2 * len(_expected(spark))
