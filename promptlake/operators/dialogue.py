"""Dialogue rows -> prompt pairs (a user turn and the assistant turn that follows it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dialogue_pairs(conv: DataFrame, prompt_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, inputs, targets): each ``prompt_role`` turn with the next turn if it is a reply.

    Written as an equi join on (conv_id, turn + 1) rather than ``lead() over (partition by
    conv_id)``: the join hashes on both columns, so a very long conversation is spread over
    many tasks instead of landing in one window partition.
    """
    u = conv.where(F.col("role") == prompt_role).select("conv_id", "turn", F.col("text").alias("inputs"))
    a = conv.where(F.col("role") == reply_role).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("targets")
    )
    return u.join(a, ["conv_id", "turn"])
