"""Mixtures as tables: membership, blacklist, and the rate rules (cap, temperature, equal).

A mixture is the set of rows ``mixture_members(mixture, task)``; its rate rule is a column
over that table. All tables here have one row per task (config-sized), so windows over a
mixture are bounded by the task count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Language sampling exponent (p(L) ~ |L|^0.3) and the equivalent temperature.
ALPHA = 0.3
TEMPERATURE = 1.0 / 0.3
RATE_DIGITS = 9


def define_mixtures(task_categories: DataFrame, definitions: DataFrame) -> DataFrame:
    """Members of each mixture: a definition row (mixture, category) selects every task of the
    category; several definition rows form a union; duplicates collapse (union + distinct)."""
    return (
        task_categories.join(definitions, "category")
        .select("mixture", "task")
        .distinct()
    )


def select_members(tasks: DataFrame, members: DataFrame, mixture: str) -> DataFrame:
    """Rows of ``tasks`` that belong to ``mixture`` (left semi join)."""
    m = members.where(F.col("mixture") == mixture).select("task")
    return tasks.join(m, "task", "left_semi")


def remove_blacklisted(members: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Members minus the blacklisted task names (left anti join)."""
    return members.join(blacklist.select("task").distinct(), "task", "left_anti")


def _norm(weight: Column, partition) -> Column:
    """Share of the total; null if the total is 0 (no member has any rows)."""
    return F.round(F.try_divide(weight, F.sum(weight).over(Window.partitionBy(*partition))), RATE_DIGITS)


def cap_rates(members: DataFrame, caps: DataFrame, partition=("mixture",)) -> DataFrame:
    """Rate proportional to the task cap, normalised within each mixture."""
    j = members.join(caps.select("task", "cap"), "task")
    return j.withColumn("rate", _norm(F.col("cap").cast("double"), partition))


def temperature_rates(sizes: DataFrame, size_col: str = "n", alpha: float = ALPHA, partition=()) -> DataFrame:
    """rate ~ n^alpha (temperature 1/alpha), normalised."""
    return sizes.withColumn("rate", _norm(F.pow(F.col(size_col).cast("double"), F.lit(alpha)), partition))


def power_rates(sizes: DataFrame, size_col: str = "cap", exponent: float = TEMPERATURE, partition=()) -> DataFrame:
    """As-coded variant of the table pipeline: rate ~ cap^(1/0.3), normalised."""
    return sizes.withColumn("rate", _norm(F.pow(F.col(size_col).cast("double"), F.lit(exponent)), partition))


def equal_rates(members: DataFrame, partition=("mixture",)) -> DataFrame:
    """Every member of an evaluation mixture gets the same rate (1 / member count)."""
    return members.withColumn("rate", F.round(F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*partition)), RATE_DIGITS))


def overlong_tasks(rows: DataFrame, length: Column, limit: int = 1024, share: float = 0.5) -> DataFrame:
    """Tasks whose rows exceed ``limit`` tokens in more than ``share`` of cases (blacklist candidates)."""
    return (
        rows.groupBy("task")
        .agg(F.avg(F.when(length > limit, 1.0).otherwise(0.0)).alias("overlong_share"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("overlong_share") > share)
    )
