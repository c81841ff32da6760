"""Datasets published in rounds: each round is its own task with its own physical splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_u
from ..functions.text import task_clean

# Physical split prefixes of a round and the logical split each maps to.
ROUND_SPLITS = {"train": "train", "validation": "dev", "test": "test"}


def round_of(key, rounds: int, seed: str = "round"):
    return F.concat(F.lit("r"), (F.lit(1) + F.floor(hash_u(seed, key) * rounds)).cast("long").cast("string"))


def round_split_tasks(data: DataFrame, template: str, rounds: int = 3) -> DataFrame:
    """Assign each row a round, name its physical split ``{prefix}_{round}``, map it back to the
    logical split and suffix the task name with the round (one plan for all rounds)."""
    phys_prefix = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in ROUND_SPLITS.items()])
    d = data.withColumn("rnd", round_of("id", rounds)).withColumn("physical", F.concat(phys_prefix, F.lit("_"), "rnd"))
    logical = F.coalesce(*[F.when(F.col("physical").startswith(v + "_"), F.lit(k)) for k, v in ROUND_SPLITS.items()])
    return d.select(
        F.concat(task_clean(F.concat("dataset", F.lit("_"), F.lit(template))), F.lit("_"), "rnd").alias("task"),
        logical.alias("split"),
        "physical",
        "id",
    )
