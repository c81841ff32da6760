"""Metric choice per (dataset, subset) and the tall (task, metric, value) table.

A prediction row has ``task, dataset, subset, id, prediction, target`` and, where it has them,
``references`` (else the target alone), ``question`` (else the id) and ``tokens``-like columns.
Every builder takes such rows and returns (task, metric, value) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import metrics as M

DEFAULT_METRIC = "Accuracy"


def _tall(df: DataFrame) -> DataFrame:
    """One row per (task, value column)."""
    names = [c for c in df.columns if c != "task"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return df.select("task", each.alias("m")).select("task", "m.*")


def _referenced(df: DataFrame) -> DataFrame:
    return df if "references" in df.columns else df.withColumn("references", F.array("target"))


def _numeric(df: DataFrame) -> DataFrame:
    """Prediction and target as numbers; rows where either is none are left out."""
    x, y = strip("prediction").try_cast("double"), strip("target").try_cast("double")
    return df.select("task", x.alias("x"), y.alias("y")).where("x is not null and y is not null")


def _stripped(df: DataFrame) -> DataFrame:
    return df.select("task", "id", strip("prediction").alias("prediction"), strip("target").alias("target"))


def _multirc(df: DataFrame) -> DataFrame:
    return M.multirc(df if "question" in df.columns else df.withColumn("question", F.col("id")))


def mean_class_f1(df: DataFrame) -> DataFrame:
    """Mean over the classes of a task (its distinct targets) of the F1 of each class."""
    s = _stripped(df)
    sides = F.explode(F.array(F.struct(F.col("prediction").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("t")), F.struct(F.col("target").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("t"))))
    right = F.when(F.col("prediction") == F.col("target"), 1).otherwise(0)
    counts = s.select("task", right.alias("tp"), sides.alias("s")).select("task", "tp", "s.*").groupBy("task", "label").agg(
        F.sum("p").alias("n_p"), F.sum("t").alias("n_t"), F.sum(F.col("tp") * F.col("t")).alias("tp")
    )
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("n_p") + F.col("n_t"))
    return counts.where("n_t > 0").groupBy("task").agg((F.avg(f1) * 100).alias("mean_class_f1"))


def matthews(df: DataFrame) -> DataFrame:
    """Matthews correlation over any number of classes; 0 where a side has one class only."""
    s = _stripped(df)
    right = F.when(F.col("prediction") == F.col("target"), 1).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("prediction").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.lit(0).alias("c")), F.struct(F.col("target").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("t"), right.alias("c"))))
    k = s.select("task", sides.alias("s")).select("task", "s.*").groupBy("task", "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("p", "t", "c")])
    t = k.groupBy("task").agg(F.sum("c").alias("c"), F.sum("t").alias("s"), F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    square = F.col("s") * F.col("s")
    value = F.try_divide(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((square - F.col("pp")) * (square - F.col("tt"))))
    return t.select("task", (F.coalesce(value, F.lit(0.0)) * 100).alias("matthews"))


# The names under which task lists ask for metrics.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "BLEU": lambda df: M.bleu(df),
    "ROUGE": lambda df: M.rouge_ns(df, (1, 2)).join(M.rouge_l(df), "task"),
    "Summary ROUGE": lambda df: M.rouge_lsum(df),
    "Span Squad": lambda df: M.squad(_referenced(df)),
    "Squad": lambda df: M.squad(_referenced(df)),
    "Trivia QA": lambda df: M.squad(_referenced(df), trivia=True),
    "Accuracy": lambda df: M.accuracy(df),
    "Sequence Accuracy": lambda df: M.sequence_accuracy(_stripped(df), "prediction", "target"),
    "Pearson Correlation": lambda df: M.pearson(_numeric(df), "x", "y"),
    "Spearman Correlation": lambda df: M.spearman(_numeric(df), "x", "y"),
    "MultiRC": _multirc,
    "AUC": lambda df: M.auc(_numeric(df), "y", "x"),
    "COQA F1": lambda df: M.squad(_referenced(df), with_em=False),
    "Edit Distance": lambda df: M.edit_distance_words(df),
    "Other": lambda df: M.accuracy(df),
    "F1": lambda df: M.class_f1(df, "1"),
    "Mean Class F1": mean_class_f1,
    "Matthews Correlation": matthews,
}

# Metric sets of two public benchmark collections by (dataset, subset); everything else
# in them, and every other dataset, has accuracy.
METRIC_SETS = [
    ("glue", "cola", "Matthews Correlation"),
    ("glue", "mrpc", "F1"),
    ("glue", "mrpc", "Accuracy"),
    ("glue", "qqp", "F1"),
    ("glue", "qqp", "Accuracy"),
    ("glue", "stsb", "Pearson Correlation"),
    ("glue", "stsb", "Spearman Correlation"),
    ("super_glue", "cb", "Mean Class F1"),
    ("super_glue", "cb", "Accuracy"),
    ("super_glue", "record", "Squad"),
]


def metric_plan(tasks: DataFrame, metric_sets: DataFrame) -> DataFrame:
    """(task, metric): ``tasks`` (task, dataset, subset) looked up in ``metric_sets`` (dataset, subset,
    metric). A set with a subset goes before one for the whole dataset (null subset), and that
    before the default."""
    own = metric_sets.where("subset is not null").select("dataset", "subset", F.col("metric").alias("own"))
    whole = metric_sets.where("subset is null").select("dataset", F.col("metric").alias("whole"))
    j = tasks.join(own, ["dataset", "subset"], "left")
    special = j.where("own is not null").select("task", F.col("own").alias("metric"))
    rest = j.where("own is null").join(whole, "dataset", "left").select("task", F.coalesce("whole", F.lit(DEFAULT_METRIC)).alias("metric"))
    return special.unionByName(rest).distinct()


# ---------------------------------------------------------------------------------------------
# families: metrics that need the same sums are taken from one pass


# Metrics of the counts of (prediction, target) pairs, and of one pass over the answers.
LABEL_METRICS = {"Accuracy": "accuracy", "Other": "accuracy", "Sequence Accuracy": "sequence_accuracy", "F1": "f1", "Pearson Correlation": "pearson"}
CLASS_METRICS = {"Mean Class F1": "mean_class_f1", "Matthews Correlation": "matthews"}
ANSWER_METRICS = {"Squad": ("em", "f1"), "Span Squad": ("em", "f1"), "COQA F1": ("f1",), "Trivia QA": ("em", "f1")}


def _named(df: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    """(task, name, metric, value): ``columns`` lists the value columns of each metric's name."""
    each = [F.struct(F.lit(n).alias("name"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for n, cs in columns.items() for c in cs]
    return df.select("task", F.explode(F.array(*each)).alias("m")).select("task", "m.*")


def pair_counts(preds: DataFrame) -> DataFrame:
    """(task, p, t, n): stripped predictions and targets with the rows that have them, one exchange with
    partial sums; nothing else of the rows is needed by label and class metrics."""
    return preds.groupBy("task", strip("prediction").alias("p"), strip("target").alias("t")).agg(F.count(F.lit(1)).alias("n"))


def label_family(pairs: DataFrame) -> DataFrame:
    """accuracy, sequence_accuracy, f1 (of the label "1") and pearson of each task by one aggregation of pair counts."""
    n, p1, t1 = F.col("n"), F.col("p") == "1", F.col("t") == "1"
    x, y = F.col("p").try_cast("double"), F.col("t").try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    # moments around values of the task itself keep small variances of large numbers
    base = pairs.where(both).groupBy("task").agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    j = pairs.join(base, "task", "left")
    dx, dy = x - F.col("x0"), y - F.col("y0")
    w = lambda v: F.sum(F.when(both, n * v))
    s = j.groupBy("task").agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("p") == F.col("t"), n).otherwise(0)).alias("right"),
        *[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in (("tp", p1 & t1), ("fp", p1 & ~t1), ("fn", ~p1 & t1))],
        *[w(v).alias(k) for k, v in (("w", F.lit(1)), ("x", dx), ("y", dy), ("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy))],
    )
    spread = lambda a, b, ab: F.col("w") * F.col(ab) - F.col(a) * F.col(b)
    hit = F.col("right") / F.col("n") * 100
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(200.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    # by two roots, so that the product cannot overflow
    pearson = F.try_divide(spread("x", "y", "xy"), F.sqrt(spread("x", "x", "xx")) * F.sqrt(spread("y", "y", "yy"))) * 100
    return s.select("task", hit.alias("accuracy"), hit.alias("sequence_accuracy"), f1.alias("f1"), pearson.alias("pearson"), (F.col("w") > 0).alias("numeric"))


def class_family(pairs: DataFrame) -> DataFrame:
    """mean_class_f1 and matthews of each task by one aggregation of labels from pair counts."""
    n, right = F.col("n"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    side = lambda label, p, t, c: F.struct(label.alias("label"), p.alias("p"), t.alias("t"), c.cast("long").alias("c"))
    sides = F.explode(F.array(side(F.col("p"), n, zero, zero), side(F.col("t"), zero, n, right)))
    k = pairs.select("task", sides.alias("s")).select("task", "s.*").groupBy("task", "label").agg(*[F.sum(c).cast("double").alias(c) for c in ("p", "t", "c")])
    f1 = F.when(F.col("t") > 0, F.try_divide(2.0 * F.col("c"), F.col("p") + F.col("t")))
    square = lambda a, b: F.sum(F.col(a) * F.col(b))
    t = k.groupBy("task").agg(F.avg(f1).alias("f1"), F.sum("c").alias("c"), F.sum("t").alias("s"), square("p", "t").alias("pt"), square("p", "p").alias("pp"), square("t", "t").alias("tt"))
    all_ = F.col("s") * F.col("s")
    value = F.try_divide(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((all_ - F.col("pp")) * (all_ - F.col("tt"))))
    return t.select("task", (F.col("f1") * 100).alias("mean_class_f1"), (F.coalesce(value, F.lit(0.0)) * 100).alias("matthews"))


def metrics_by_task(preds: DataFrame, plan: DataFrame) -> DataFrame:
    """Every metric that ``plan`` (task, metric) asks for, over the rows of its tasks only.

    The predictions of the plan's tasks are read once and written. Metrics of one family share its
    pass: label and class metrics the counts of (prediction, target) pairs, answer metrics one
    explode of the tokens (two with Trivia QA, which normalises otherwise); the others run alone.
    The names asked for are read first (a few, as many as the registry has at most); an unknown
    name is an error, not an empty result."""
    from ..session import cut_lineage

    plan = cut_lineage(plan.select("task", "metric").distinct(), "metric_plan")
    names = sorted(r["metric"] for r in plan.select("metric").distinct().limit(len(METRICS) + 1).collect())
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"no such metric: {unknown}; there are {sorted(METRICS)}")
    if not names:
        return preds.select("task", F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)
    of = lambda some: plan.where(F.col("metric").isin(some)).select("task").distinct()
    preds = cut_lineage(preds.join(of(names), "task", "left_semi"), "planned_predictions")
    rows = lambda some: preds.join(of(some), "task", "left_semi")
    parts, left = [], set(names)

    counted = sorted(left & (LABEL_METRICS.keys() | CLASS_METRICS.keys()))
    if counted:
        pairs = cut_lineage(pair_counts(rows(counted)), "pair_counts")
        for family, table in ((label_family, LABEL_METRICS), (class_family, CLASS_METRICS)):
            asked = {n: (table[n],) for n in counted if n in table}
            if asked:
                found = family(pairs)
                part = _named(found, asked)
                if "Pearson Correlation" in asked:  # a task without numbers has no correlation, not a null one
                    part = part.join(found.where("numeric").select("task").withColumn("name", F.lit("Pearson Correlation")), ["task", "name"], "left_semi").unionByName(part.where("name <> 'Pearson Correlation'"))
                parts.append(part)
    for trivia in (False, True):
        asked = {n: ANSWER_METRICS[n] for n in names if n in ANSWER_METRICS and (n == "Trivia QA") == trivia}
        if asked:
            parts.append(_named(M.squad(_referenced(rows(list(asked))), trivia=trivia), asked))
    for n in sorted(left - LABEL_METRICS.keys() - CLASS_METRICS.keys() - ANSWER_METRICS.keys()):
        parts.append(_tall(METRICS[n](rows([n]))).withColumn("name", F.lit(n)))
    out = reduce(DataFrame.unionByName, parts)
    asked_for = plan.select("task", F.col("metric").alias("name"))
    return out.join(asked_for, ["task", "name"], "left_semi").select("task", "metric", "value").distinct()
