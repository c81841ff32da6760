"""Prompted task building: templates x datasets -> capped, rendered (inputs, targets) rows.

This is the reference's "add every template of a dataset as a task, cap it, shuffle it with
seed 42 + template ordinal, render it" done as one Spark plan for all tasks at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import MAX_EXAMPLES, cap_rule_a, cap_rule_b
from ..operators.ranking import broadcast_checked, seeded_cap_late
from ..operators.templates import nonempty_pairs, render_templates, usable_templates

# The prompt set applied to every (dataset, subset) of the corpus in the tests
# and benchmarks: (name, template text, answer choices, original_task).
CORPUS_PROMPTS = [
    ("quality", "{{ text }}\nIs this text well written? ||| {{ answer_choices[quality] }}", "No ||| Yes", True),
    ("toxic", "{{ text }}\nIs this text toxic? ||| {{ answer_choices[toxic] }}", "No ||| Yes", True),
]
# A wider set used by the multi-template fan-out queries.
CORPUS_PROMPTS_WIDE = CORPUS_PROMPTS + [
    ("language", "Which language is this text written in?\n{{ text }} ||| {{ subset }}", None, False),
    ("source", "{{ text }}\nWhere does this text come from? ||| {{ dataset }}", None, False),
    ("quality-translate-de", "{{ text }}\nIst dieser Text gut geschrieben? ||| {{ answer_choices[quality] }}", "Nein ||| Ja", False),
]
# Base seed of the per-template shuffle (seed = 42 + template ordinal).
BASE_SEED = 42
FIELDS = ["id", "text", "dataset", "subset", "split", "n_chars", "quality", "toxic"]


def corpus_templates(data: DataFrame, prompts=CORPUS_PROMPTS, materialise: bool = True) -> DataFrame:
    """One template row per (dataset, subset) of ``data`` and prompt, with its ordinal.

    The prompt list is exploded onto the distinct dataset keys (no join). With ``materialise`` the
    result is written, measured and marked for broadcast if it is small.
    """
    arr = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(n).alias("name"),
                F.lit(j).alias("jinja"),
                F.lit(c).cast("string").alias("answer_choices"),
                F.lit(o).alias("original_task"),
            )
            for i, (n, j, c, o) in enumerate(prompts)
        ]
    )
    t = data.select("dataset", "subset").distinct().select("dataset", "subset", F.explode(arr).alias("t")).select(
        "dataset", "subset", "t.*"
    )
    if materialise:
        t = broadcast_checked(t, "templates")
    return t


def task_caps(data: DataFrame, templates: DataFrame, rule: str = "b", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Cap per (dataset, subset) from its train size and its number of templates."""
    n = data.where(F.col("split") == "train").groupBy("dataset", "subset").agg(F.count(F.lit(1)).alias("n"))
    t = templates.groupBy("dataset", "subset").agg(F.count(F.lit(1)).alias("num_templates"))
    j = t.join(n, ["dataset", "subset"], "left")
    if rule == "a":
        cap = cap_rule_a(F.col("n"), F.col("num_templates"), F.col("n").isNotNull(), max_examples)
    else:
        cap = cap_rule_b(F.coalesce(F.col("n"), F.lit(0)), F.col("num_templates"), max_examples)
    return j.select("dataset", "subset", "num_templates", F.coalesce(F.col("n"), F.lit(0)).alias("n"), cap.alias("cap"))


def prompt_tasks(data: DataFrame, prompts=CORPUS_PROMPTS, rule: str = "b", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Control table: one row per (dataset, subset, prompt) with ordinal, template text, train
    size ``n``, ``num_templates``, ``cap`` and ``task`` — from ONE narrow aggregation over the
    data, then written and measured before it is broadcast. Cap rules: "a", "b" (with
    ``max_examples`` rows), or "share" (``max_examples`` is the share of the task that is kept)."""
    from ..functions.text import task_name as _tn

    stats = data.groupBy("dataset", "subset").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("long").alias("n")
    )
    T = F.lit(len(prompts))
    if rule == "a":
        cap = cap_rule_a(F.col("n"), T, F.col("n") > 0, max_examples)
    elif rule == "share":
        cap = F.ceil(F.col("n") * F.lit(float(max_examples)))
    else:
        cap = cap_rule_b(F.col("n"), T, max_examples)
    arr = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(n).alias("name"),
                F.lit(j).alias("jinja"),
                F.lit(c).cast("string").alias("answer_choices"),
                F.lit(o).alias("original_task"),
            )
            for i, (n, j, c, o) in enumerate(prompts)
        ]
    )
    t = stats.select("dataset", "subset", "n", T.alias("num_templates"), cap.alias("cap"), F.explode(arr).alias("t"))
    t = t.select("dataset", "subset", "n", "num_templates", "cap", "t.*").withColumn("task", _tn("dataset", "subset", "name"))
    return broadcast_checked(t, "tasks")


def build_prompts(
    spark: SparkSession,
    sf_dir: str,
    prompts=CORPUS_PROMPTS,
    rule: str = "b",
    max_examples: int = MAX_EXAMPLES,
    only_tasks: DataFrame | None = None,
    map_fn: Callable[[DataFrame], DataFrame] | None = None,
    keep: tuple[str, ...] = ("task", "id"),
) -> DataFrame:
    """Capped, rendered prompt rows of every (dataset, subset, prompt) task of the corpus.

    Templates that cannot be rendered are left out. ``only_tasks`` limits the build itself: the
    rows of other tasks are neither ranked nor rendered. ``map_fn`` is a table function over the
    corpus rows (a row map or filter) that runs before the templates are attached.

    Plan: control table (narrow pass) -> broadcast fan-out of train ids -> seeded cap over ids (one
    narrow histogram pass, then only ~cap ids per task are shuffled) -> labels joined to the kept
    ids -> texts, dropped beyond the cut in their scan, meet the kept ids -> template texts ->
    render -> non-empty filter. No window and no exchange before the cut carries a text.
    """
    from ..sources.tables import corpus, read

    data = corpus(spark, sf_dir)
    if map_fn is not None:
        data = map_fn(data)
    tasks = broadcast_checked(usable_templates(prompt_tasks(data, prompts, rule, max_examples), FIELDS), "tasks")
    if only_tasks is not None:
        tasks = broadcast_checked(tasks.join(broadcast_checked(only_tasks.select("task"), "only_tasks"), "task", "left_semi"), "tasks")
    tpl = tasks.withColumnRenamed("name", "template").withColumnRenamed("answer_choices", "tpl_choices")
    by = ["dataset", "subset"]
    keys = tpl.select(*by, "template", "ordinal", "cap")  # parts of the measured table keep its broadcast mark
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    train = data.where(F.col("split") == "train")
    seed = (F.lit(BASE_SEED) + F.col("ordinal")).cast("string")
    rows = seeded_cap_late(
        train.select(*by, "id").join(keys, by), train.join(keys, by), [*by, "template"], seed, "id", "cap", lambda kept: kept.join(labels, "id", "left")
    ).drop("ordinal", "cap")
    rows = rows.join(tpl.drop("n", "cap", "ordinal"), [*by, "template"])
    rendered = render_templates(rows, FIELDS, keep=list(keep))
    return nonempty_pairs(rendered).select(*keep, "inputs", "targets")


def flagship(spark: SparkSession, sf_dir: str, max_examples: int = MAX_EXAMPLES, only_tasks: DataFrame | None = None, keep=("task",)) -> DataFrame:
    """documents x labels -> two labelled prompts -> <NO LABEL> fill -> non-empty -> seeded cap."""
    out = build_prompts(spark, sf_dir, CORPUS_PROMPTS, "b", max_examples, only_tasks, keep=(*keep, "id"))
    return out.select(*keep, F.col("id").alias("doc_id"), "inputs", "targets")


def flagship_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task names of the flagship build (one row per (dataset, subset, prompt))."""
    from ..functions.text import task_name as _tn
    from ..sources.tables import corpus

    t = corpus_templates(corpus(spark, sf_dir), CORPUS_PROMPTS, materialise=False)
    return t.select(_tn("dataset", "subset", "name").alias("task"), F.col("name").alias("template"))
