"""Dataset statistics and per-task caps.

Statistics are ordinary grouped counts over the scanned tables (partial aggregation happens
map-side, only one row per (dataset, subset, split) crosses the shuffle). Caps are column
expressions over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Row cap per dataset/task used by both of the reference's pipelines.
MAX_EXAMPLES = 500_000


def dataset_stats(data: DataFrame, keys=("dataset", "subset", "split")) -> DataFrame:
    """Row count per (dataset, subset, split)."""
    return data.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_examples"))


def train_sizes(stats: DataFrame, split: str = "train") -> DataFrame:
    return stats.where(F.col("split") == split).select("dataset", "subset", F.col("num_examples").alias("n"))


def cap_rule_a(n: Column, num_templates: Column, has_train: Column, max_examples: int = MAX_EXAMPLES) -> Column:
    """Rule of the registry pipeline: n > max -> max div T; else n; no train split -> max."""
    return (
        F.when(~has_train | n.isNull(), F.lit(max_examples))
        .when(n > max_examples, F.floor(F.lit(max_examples) / num_templates))
        .otherwise(n)
        .cast("long")
    )


def cap_rule_b(n: Column, num_templates: Column, max_examples: int = MAX_EXAMPLES) -> Column:
    """Rule of the table pipeline: n * T > max -> max div T; else n."""
    return F.when(n * num_templates > max_examples, F.floor(F.lit(max_examples) / num_templates)).otherwise(n).cast("long")


def weighted_train_size(sizes: DataFrame, rates: DataFrame, key: str = "pair") -> DataFrame:
    """Sum of ``int(n * rate)`` over the members (the MT task's cap)."""
    return sizes.join(rates, key).agg(
        F.sum(F.floor(F.col("n") * F.col("rate")).cast("long")).alias("train_size")
    )


def cap_merge(caps: DataFrame, key: str = "task", seq: str = "seq", value: str = "cap") -> DataFrame:
    """Dict merge in registration order: for each key the last written value wins."""
    return caps.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def catalog_rollup(catalog: DataFrame) -> DataFrame:
    """Datasets and training rows per (category, train flag) with sub- and grand totals."""
    return (
        catalog.withColumn("train_flag", F.col("do_train").isNotNull())
        .rollup("task_by_convention", "train_flag")
        .agg(F.count(F.lit(1)).alias("datasets"), F.sum("train_size").alias("rows"))
    )


def exclusive_cumsum(df: DataFrame, value: str, order: list[str], out: str = "offset", partition=()) -> DataFrame:
    """Offsets = exclusive running sum (small tables only: one row per source)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
