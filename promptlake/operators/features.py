"""Model feature rows for generation: decoder-only (causal / prefix) and encoder-decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PAD, causal_attention, non_padding, pad_to, prefix_concat, shift_right


def longest(df: DataFrame, ids: str) -> int:
    """Length of the longest id array (0 for no rows)."""
    return df.agg(F.max(F.size(ids))).first()[0] or 0


def generation_rows(df: DataFrame, ids: str, model_types: list[str], length: int) -> DataFrame:
    """One row per (prompt, model type). Decoder-only: targets = prompt ++ padding to
    ``length``, decoder inputs shifted right, causal-attention prefix of prompt length + 1.
    Encoder-decoder: the prompt feeds the encoder, decoder targets are ``length`` pads. Choose
    ``length`` from the longest prompt (``longest``); a longer prompt would be cut."""
    x = df.withColumn("model_type", F.explode(F.array(*[F.lit(m) for m in model_types])))
    enc = F.col("model_type") == "enc_dec"
    n = F.size(ids)
    pad_targets = F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - n, F.lit(0)))
    dec_targets, _, width1 = prefix_concat(ids, pad_targets)
    zeros = F.array_repeat(F.lit(PAD), length)
    return x.select(
        "*",
        F.when(enc, F.col(ids)).alias("encoder_input_tokens"),
        F.when(enc, zeros).otherwise(pad_to(dec_targets, length)).alias("decoder_target_tokens"),
        F.when(enc, shift_right(zeros)).otherwise(shift_right(pad_to(dec_targets, length))).alias("decoder_input_tokens"),
        F.when(~enc, causal_attention(pad_to(width1, length))).alias("decoder_causal_attention"),
        F.when(enc, non_padding(zeros)).alias("decoder_loss_weights"),
    )
