"""Chat formatting after the collapse of cumulative snapshots.

Loggers often store a conversation again after every turn. A conversation whose turns are the
first turns of a longer one is dropped, and of equal ones the smallest id stays, before rendering.

Turns are numbered within their conversation in two phases. The hash of a prefix is the exclusive
or of the hashes of its (number, role, text), over two 64-bit hashes, so it rolls over turns: a
running sum over blocks of ``BLOCK`` turns, then within them. The hash of the prefix before a turn
is the one up to it without its own. Distinct prefix hashes and lengths are removed from the
distinct whole conversations by an anti-join. A conversation is rendered in parts of ``BLOCK``
turns. So no task holds a conversation, a first turn or a snapshot group as a whole.

DataFrame functions only.

Defined results: turns without a conversation id belong to none and are left out; a null turn
number sorts first, null roles and texts are empty, an empty role renders as ``user``; equal rows
(conversation, turn, role, text) are one turn; turns with equal numbers are ordered by role, then
text; ``<|`` inside a role or text is rendered as ``< |``, so no text can close its own turn; empty
tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import two_phase_rank
from ..session import cut_lineage

BLOCK = 1024


def _numbered(turns: DataFrame) -> DataFrame:
    low = F.lit(-(1 << 63))
    bucket = F.floor(F.coalesce("turn", low) / BLOCK)
    return two_phase_rank(turns, "conv_id", ["turn", "role", "text"], bucket, "i")


def _prefixes(numbered: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, ta, tb): hash of the first i turns and of the i-th alone."""
    terms = numbered.select("conv_id", "i", F.xxhash64("i", "role", "text").alias("ta"), F.xxhash64(F.lit("b"), "i", "role", "text").alias("tb"))
    terms = terms.withColumn("block", F.floor((F.col("i") - 1) / BLOCK))
    sums = terms.groupBy("conv_id", "block").agg(F.bit_xor("ta").alias("sa"), F.bit_xor("tb").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = sums.select("conv_id", "block", F.coalesce(F.bit_xor("sa").over(before), zero).alias("pa"), F.coalesce(F.bit_xor("sb").over(before), zero).alias("pb"))
    inside = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rolled = terms.join(starts, ["conv_id", "block"])
    roll = lambda t, p: F.bit_xor(t).over(inside).bitwiseXOR(F.col(p))
    return rolled.select("conv_id", "i", roll("ta", "pa").alias("a"), roll("tb", "pb").alias("b"), "ta", "tb")


def maximal(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, ids of the conversations that are no prefix and no later copy of another)."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    numbered = cut_lineage(_numbered(turns.distinct()), "turns")
    prefixes = cut_lineage(_prefixes(numbered), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("i", "a", "b")).alias("all")).select("conv_id", "all.*")
    whole = whole.groupBy("i", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    shorter = prefixes.where("i > 1").select((F.col("i") - 1).alias("i"), F.col("a").bitwiseXOR(F.col("ta")).alias("a"), F.col("b").bitwiseXOR(F.col("tb")).alias("b")).distinct()
    kept = whole.join(shorter, ["i", "a", "b"], "left_anti").select("conv_id", F.col("i").alias("n_turns"))
    return numbered, cut_lineage(kept, "maximal")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as (conv_id, part, n_turns, text): the parts in order are the chat."""
    src = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    numbered, kept = maximal(src)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.when(F.col("role") == "", F.lit("user")).otherwise(safe(F.col("role")))
    turn = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe(F.col("text")), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("i") - 1) / BLOCK).cast("int")
    rendered = numbered.join(kept, "conv_id", "left_semi").select("conv_id", part.alias("part"), F.struct("i", turn.alias("t")).alias("turn"))
    parts = rendered.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return parts.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("turns.t")).alias("text"))
