"""Language-model text tasks: non-empty text rows rekeyed to (inputs = null, targets = text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lm_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(text) > 0)


def rekey_lm(df: DataFrame, text: str = "text", keep=()) -> DataFrame:
    return df.select(*keep, F.lit(None).cast("string").alias("inputs"), F.col(text).alias("targets"))
