"""Registered query: joins over tables laid out once by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.templates import attach_templates, nonempty_pairs, render_templates, template_filter
from ..session import scratch_path
from ..sources.bucketed import laid_out
from ..sources.tables import corpus, read, split_of
from .prompt_queries import _wide_sql
from .prompts import CORPUS_PROMPTS_WIDE, FIELDS, corpus_templates
from .registry import register
from .sqlparts import LABELLED_SQL, TASK

# Fixed value: buckets of the layouts.
LAYOUT_BUCKETS = 16


def labelled_layout(docs, labels):
    """Labelled corpus rows from two layouts by ``doc_id``: joined on that column itself, which keeps the buckets."""
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("dataset"), F.col("lang").alias("subset"), split_of("doc_id").alias("split"), "n_chars", "quality", "toxic"
    )


@register(
    "render_bucketed",
    f"""WITH c AS ({LABELLED_SQL}), r AS ({_wide_sql(['quality', 'toxic', 'language', 'source'])})
        SELECT {TASK('dataset', 'subset', 'template')} AS task, id, inputs, targets FROM r""",
)
def q_render_bucketed(spark, sf_dir):
    """Documents and labels laid out by document id, joined bucket by bucket, and rendered."""
    path = scratch_path(spark, "layouts")
    docs, labels = (laid_out(read(spark, sf_dir, t), f"{path}/{t}", "doc_id", LAYOUT_BUCKETS) for t in ("documents", "labels"))
    templates = template_filter(corpus_templates(corpus(spark, sf_dir), CORPUS_PROMPTS_WIDE), include_translated=False)
    rows = attach_templates(labelled_layout(docs, labels), templates)
    return nonempty_pairs(render_templates(rows, FIELDS, keep=["task", "id"])).select("task", "id", "inputs", "targets")
