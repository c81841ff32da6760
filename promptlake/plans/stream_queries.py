"""Registered queries: streaming prompt rendering and hash sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import corpus, read
from ..sources.cache import PARTITIONS
from ..streaming.prompts import corpus_stream, run_to_parquet, stream_capped_pairs, stream_prompt_pairs, stream_sample
from .prompt_queries import _wide_sql
from .prompts import CORPUS_PROMPTS, FIELDS, corpus_templates, prompt_tasks
from .registry import register
from .sqlparts import LABELLED_SQL, TASK, U

# Datasets excluded from the streamed prompts, and the stream sample rate.
STREAM_BLACKLIST = ["src0"]
SAMPLE_RATE = 0.25
CACHE_SHARE = 0.5


@register(
    "stream_prompts",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, id, inputs, targets FROM r WHERE dataset NOT IN ('src0')""",
)
def q_stream_prompts(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    templates = corpus_templates(corpus(spark, sf_dir), CORPUS_PROMPTS)
    blacklist = spark.createDataFrame([(d,) for d in STREAM_BLACKLIST], "dataset string")
    s = stream_prompt_pairs(corpus_stream(spark, sf_dir), labels, templates, blacklist, FIELDS)
    return run_to_parquet(s, "stream_prompts")


@register(
    "stream_cache",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic'])}),
          n AS (SELECT dataset, subset, count(*) AS n FROM c WHERE split = 'train' GROUP BY dataset, subset)
        SELECT {TASK('r.dataset', 'r.subset', 'template')} AS task, id, inputs, targets
        FROM r JOIN n USING (dataset, subset) JOIN (SELECT id AS cid, split FROM c) s ON s.cid = r.id
        WHERE s.split = 'train' AND {U("CASE template WHEN 'quality' THEN '42' ELSE '43' END", 'id')} < ceil(n * CAST({CACHE_SHARE} AS DOUBLE)) / n""",
)
def q_stream_cache(spark, sf_dir):
    """New documents -> capped prompt rows in the task cache's layout (task / template)."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    tasks = prompt_tasks(corpus(spark, sf_dir), CORPUS_PROMPTS, "share", CACHE_SHARE)
    s = stream_capped_pairs(corpus_stream(spark, sf_dir), labels, tasks, FIELDS).drop("answer_choices")
    return run_to_parquet(s, "stream_cache", PARTITIONS).select("task", "id", "inputs", "targets")


@register(
    "stream_sample",
    f"SELECT doc_id, lang FROM documents WHERE {U(repr('sample'), 'doc_id')} < {SAMPLE_RATE}",
)
def q_stream_sample(spark, sf_dir):
    s = stream_sample(corpus_stream(spark, sf_dir), SAMPLE_RATE).select("doc_id", "lang")
    return run_to_parquet(s, "stream_sample")


# Deliveries of the documents in the resumed stream, and rows admitted per task.
DELIVERIES = 3
FIRST_ROWS = 20


def deliver(docs, folder: str, part: int) -> None:
    """Stand-in of a feed: the ``part``-th of DELIVERIES ranges of ids arrives as files."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    share = F.floor((F.col("doc_id") - F.lit(lo)) * DELIVERIES / F.lit(hi - lo + 1))
    docs.where(share == part).write.parquet(f"{folder}/delivery-{part}")


@register(
    "stream_cache_resume",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic'])}),
          k AS (SELECT id, row_number() OVER (PARTITION BY dataset, subset ORDER BY id) AS rn FROM c WHERE split = 'train')
        SELECT {TASK('r.dataset', 'r.subset', 'template')} AS task, id, inputs, targets FROM r JOIN k USING (id) WHERE rn <= {FIRST_ROWS}""",
)
def q_stream_cache_resume(spark, sf_dir):
    """Documents arrive in three deliveries; the job is started after each and goes on with its own
    checkpoint and sink: the first rows of each task by arrival, exactly its cap."""
    from ..session import scratch_path
    from ..streaming.resume import feed_stream, read_stream_cache, run_into_cache

    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    tasks = prompt_tasks(corpus(spark, sf_dir), CORPUS_PROMPTS).withColumn("cap", F.lit(FIRST_ROWS))
    tasks = tasks.withColumnRenamed("name", "template").withColumnRenamed("answer_choices", "tpl_choices")
    folder, path, checkpoint = (scratch_path(spark, f"resume-{x}") for x in ("feed", "cache", "checkpoint"))
    for part in range(DELIVERIES):
        deliver(docs, folder, part)
        run_into_cache(feed_stream(spark, folder, docs.schema), tasks, labels, path, checkpoint, FIELDS)
    return read_stream_cache(spark, path).select("task", "id", "inputs", "targets")
