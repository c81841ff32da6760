"""Distributed ranks, seeded shuffles, caps, take/skip and batch ids.

A plain ``row_number() over (partition by g order by ...)`` sends a whole group to one task; a
group can be a third of the corpus, and a global rank (no ``partition by``) sends everything to
one task. ``two_phase_rank`` avoids both: rows are first spread over ``buckets`` sub-ranges of the
ordering, a small (group, bucket) -> count table gives each bucket its exclusive prefix offset,
and the final rank is ``offset + row_number()`` inside (group, bucket). The big side is shuffled
exactly once, on (group, bucket), and the join with the offsets table reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_u

DEFAULT_BUCKETS = 256


def _cols(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def two_phase_rank(
    df: DataFrame,
    group_cols: Sequence[str] | str | None,
    order_cols: Sequence[str],
    bucket: Column,
    out: str = "rn",
) -> DataFrame:
    """1-based ``row_number() over (partition by group_cols order by order_cols)``.

    ``bucket`` must be a non-decreasing function of the ordering (e.g. ``floor(u * B)`` when
    ordering by ``u``, or ``pos div block`` when ordering by ``pos``) and ``order_cols`` must
    make the order total.
    """
    g = _cols(group_cols)
    b = "__bucket"
    with_b = df.withColumn(b, bucket.cast("long"))
    counts = with_b.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_off), F.lit(0))).drop("__n")
    w_in = Window.partitionBy(*g, b).orderBy(*order_cols)
    return (
        with_b.join(offsets, [*g, b])
        .withColumn(out, (F.col("__off") + F.row_number().over(w_in)).cast("long"))
        .drop("__off", b)
    )


def seeded_rank(
    df: DataFrame,
    group_cols,
    seed,
    key: str,
    out: str = "rn",
    buckets: int = DEFAULT_BUCKETS,
    u_col: str = "u",
) -> DataFrame:
    """Rank rows of each group by ``(hash_u(seed, key), key)`` — a reproducible shuffle."""
    if u_col not in df.columns:
        df = df.withColumn(u_col, hash_u(seed, key))
    return two_phase_rank(df, group_cols, [u_col, key], F.floor(F.col(u_col) * buckets), out)


# Log-scale histogram resolution (buckets per halving of the hash). With 64
# steps a bucket holds about 1.1 % of the rows below it, so the largest rank partition of a
# cap is about 1 % of the cap.
LOG_STEPS = 64


def _log_bucket(u: Column) -> Column:
    """floor(-64 * log2(u)): ascending u <=> descending bucket; u = 0 goes to a last bucket."""
    return F.when(u <= 0, F.lit(1 << 20)).otherwise(F.floor(-F.log2(u) * LOG_STEPS)).cast("int")


def _cap_tables(df: DataFrame, g: list[str], seed, key: str, cap_col: str) -> tuple[DataFrame, DataFrame]:
    """(cuts, offsets) of a seeded cap: per group the log bucket that still holds ``min(cap, n)`` rows,
    and per kept bucket the rows of smaller hash.

    The histogram they come from is small (groups x buckets); it is written once so that both read
    the same rows and the main pass does not rescan the input for them."""
    from ..session import cut_lineage

    work = df.withColumn("__lb", _log_bucket(hash_u(seed, key)))
    hist = cut_lineage(work.groupBy(*g, "__lb").agg(F.count(F.lit(1)).alias("__c"), F.max(cap_col).alias("__cap")), "cap_hist")
    w_cum = Window.partitionBy(*g).orderBy(F.col("__lb").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(*g)
    hist = (
        hist.withColumn("__cum", F.sum("__c").over(w_cum))
        .withColumn("__n", F.sum("__c").over(w_all))
        .withColumn("__gcap", F.max("__cap").over(w_all))
    )
    need = F.least(F.col("__gcap"), F.col("__n"))
    cuts = broadcast_checked(hist.where(F.col("__cum") >= need).groupBy(*g).agg(F.max("__lb").alias("__lbcut")), "cap_cuts")
    offsets = hist.join(cuts, g).where(F.col("__lb") >= F.col("__lbcut")).select(*g, "__lb", (F.col("__cum") - F.col("__c")).alias("__off"))
    return cuts, offsets


def _below_cut(df: DataFrame, g: list[str], seed, key: str, cuts: DataFrame) -> DataFrame:
    """Rows whose hash lies in a kept bucket, with the hash ``u`` and the bucket; nothing is shuffled."""
    work = df.withColumn("u", hash_u(seed, key)).withColumn("__lb", _log_bucket(F.col("u")))
    return work.join(cuts, g).where(F.col("__lb") >= F.col("__lbcut")).drop("__lbcut")


def _ranked(kept: DataFrame, g: list[str], key: str, cap_col: str, offsets: DataFrame) -> DataFrame:
    w_in = Window.partitionBy(*g, "__lb").orderBy("u", key)
    ranked = kept.join(offsets, [*g, "__lb"]).withColumn("rn", (F.col("__off") + F.row_number().over(w_in)).cast("long")).drop("__off", "__lb")
    return ranked.where(F.col("rn") <= F.col(cap_col))


def seeded_cap(
    df: DataFrame,
    group_cols,
    seed,
    key: str,
    cap_col: str,
    keep_rank: bool = False,
) -> DataFrame:
    """Exact "shuffle with seed, then keep the first ``cap`` rows" per group, without a global sort.

    ``df`` carries a per-row ``cap_col`` (constant within a group); ``seed`` may be a Column
    (per-template seeds). Plan:

    1. one narrow pass builds a per-group histogram of the hash on a log scale (a few hundred
       to a few thousand rows per group; partial aggregation map-side), written once to the
       shared folder;
    2. from it each group gets the bucket cut that still holds ``min(cap, n)`` rows, and every
       kept bucket gets its exact rank offset (rows in buckets of smaller hash);
    3. rows beyond the cut are dropped before any shuffle (broadcast join against one row per
       group); the kept rows (about ``cap``) are shuffled by (group, bucket) and ranked
       ``offset + row_number()`` inside their bucket.

    The cut table is broadcast only if its measured size allows (``broadcast_checked``). All columns
    of ``df`` go through the rank; for rows with texts use ``seeded_cap_late``.
    """
    g = _cols(group_cols)
    cuts, offsets = _cap_tables(df, g, seed, key, cap_col)
    out = _ranked(_below_cut(df, g, seed, key, cuts), g, key, cap_col, offsets)
    return out if keep_rank else out.drop("rn", "u")


def seeded_cap_late(
    keys: DataFrame,
    wide: DataFrame,
    group_cols,
    seed,
    key: str,
    cap_col: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``seeded_cap`` for rows with texts: only (group, key, cap) go through the ranks.

    ``keys`` and ``wide`` hold the same rows, ``keys`` without the texts. The kept keys are joined
    with what ``enrich`` adds to them (a function of the kept keys), written and measured; then
    ``wide`` is read once more: rows beyond the cut are dropped in the scan, the others meet their
    keys last, in a broadcast join if the kept keys are few, else in one exchange of rows that are
    nearly all kept. ``key`` must be unique in a group."""
    g = _cols(group_cols)
    cuts, offsets = _cap_tables(keys, g, seed, key, cap_col)
    kept = _ranked(_below_cut(keys, g, seed, key, cuts), g, key, cap_col, offsets).select(*g, key)
    kept = broadcast_checked(enrich(kept) if enrich else kept, "kept_keys")
    return _below_cut(wide, g, seed, key, cuts).drop("u", "__lb").join(kept, [*g, key])


MAX_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 8 per fixed-width column, the length of the others as text or JSON."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(df[f.name]), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(df[f.name]))), F.lit(0)) + 8
        else:
            size = size + 8
    return size


def broadcast_checked(df: DataFrame, name: str, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a derived table only after measuring it: its bytes are summed and must be within
    ``max_bytes``; beyond that it stays a plain (shuffle) join input.

    The table is written to the shared folder first, so that the rows that were measured are the
    rows that are joined, and its plan runs once."""
    from ..session import cut_lineage

    df = cut_lineage(df, name)
    total = df.agg(F.sum(_row_bytes(df)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= max_bytes else df


def take_skip(df: DataFrame, seed, key: str, n: int, part: str = "take") -> DataFrame:
    """Eval hold-out: the first ``n`` rows in seeded order (``take``) or all the others (``skip``).

    ``take`` is a seeded cap over one group; ``skip`` removes exactly those keys with an anti
    join whose side is broadcast only if its measured size allows.
    """
    capped = seeded_cap(df.withColumn("__one", F.lit(1)).withColumn("__cap", F.lit(n)), "__one", seed, key, "__cap")
    capped = capped.drop("__one", "__cap")
    if part == "take":
        return capped
    return df.join(broadcast_checked(capped.select(key), "held_out"), key, "left_anti")


def batch_ids(df: DataFrame, seed, key: str, batch_size: int, buckets: int = 1 << 16) -> DataFrame:
    """Global seeded row number and ``batch = (rn - 1) div batch_size``.

    ``buckets`` hash ranges split the single global order (about 1.5 M rows per bucket at
    10^11 rows); the per-bucket counts table is small and its prefix offsets are joined back."""
    ranked = seeded_rank(df, None, seed, key, "rn", buckets)
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / F.lit(batch_size)).cast("long"))
