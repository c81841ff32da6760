"""Interleaving sources: round robin and seeded draws by rate, as joins and windows.

Sequential semantics being reproduced (per draw position ``pos = 0, 1, ...``, a source is
picked by rate; the picked source hands out its next row):

* round robin: rows ``0..min(len)-1`` of every source, in (row, source) order;
* ``first_exhausted``: stop at the first draw of a source that has no row left;
* ``all_exhausted``: an exhausted source restarts at its first row; stop at the draw that
  would complete "every source exhausted at least once".

Closed form: with ``k`` = running count of draws of the picked source and ``e_s`` = position of
the ``(len_s + 1)``-th draw of source ``s``, keep ``pos < min_s e_s`` (first) or
``pos < max_s e_s`` (all); the row handed out is ``(k - 1) mod len_s``. The draws are a
``range`` with a per-position hash, the counters come from ``two_phase_rank`` (blocks of
positions), and rows are fetched with one equi join on (source, row index).

The random stream is the library's hash of ``seed:pos`` (not a PRNG, 52 bits of it), so the result
is the same for any partitioning and is reproducible in SQL. Sizes and rates are tables with one
row per source; a draw finds its source by a join on bins of the cumulative weights. Only ids go
through ranks and draws: callers fetch texts last, by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_u52
from ..session import cut_lineage
from .ordered import ROWS_PER_TASK, ordered_rank
from .ranking import broadcast_checked, two_phase_rank

# Sum of the integer weights (about; rates are normalised to it), bins of the
# cumulative weights, positions per rank block.
WEIGHT_SCALE = 1 << 44
BINS = 1 << 12
POS_BLOCK = 1 << 20


def index_sources(df: DataFrame, source: str, order: str, out: str = "idx", block: int = ROWS_PER_TASK) -> DataFrame:
    """0-based row index inside each source, ordered by ``order``.

    Sources of more than ``block`` rows are ranked over sampled ranges of the key, by many tasks.
    Pass ids only; join the other columns back by key."""
    return ordered_rank(df, source, order, "__rn", rows_per_task=block).withColumn(out, F.col("__rn") - 1).drop("__rn")


def source_sizes(rows: DataFrame, source: str) -> DataFrame:
    """(source, n): one row per source, counted on the rows as they are (no index needed)."""
    return cut_lineage(rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")), "source_sizes")


def round_robin(indexed: DataFrame, source: str, idx: str = "idx", sizes: DataFrame | None = None) -> DataFrame:
    """Rows ``idx < min(len)`` of every source with ``pos = idx * S + ordinal(source)``."""
    sizes = sizes if sizes is not None else source_sizes(indexed, source)
    # windows over one row per source
    each = sizes.select(source, (F.row_number().over(Window.orderBy(source)) - 1).alias("__o"), F.min("n").over(Window.partitionBy()).alias("__m"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__s"))
    joined = indexed.join(broadcast_checked(each, "ordinals"), source).where(F.col(idx) < F.col("__m"))
    return joined.withColumn("pos", (F.col(idx) * F.col("__s") + F.col("__o")).cast("long")).drop("__o", "__m", "__s")


def weight_table(sizes: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """(source, n, w, lo, hi): integer weights of about ``WEIGHT_SCALE`` in all and their cumulative ranges.

    ``rates`` (source, rate) must have exactly the sources of ``sizes``, each with a positive rate."""
    j = sizes.join(rates.select(F.col(source), F.col("rate").cast("double").alias("rate")), source, "full")
    bad = j.where(F.col("n").isNull() | F.col("rate").isNull() | ~(F.col("rate") > 0) | (F.col("n") <= 0)).limit(5).collect()
    if bad:
        raise ValueError(f"sources and rates differ, or a source has no rows or no positive rate: {[r[source] for r in bad]}")
    one = Window.partitionBy()
    w = F.greatest(F.floor(F.col("rate") / F.sum("rate").over(one) * F.lit(float(WEIGHT_SCALE))).cast("long"), F.lit(1).cast("long"))
    j = j.select(source, "n", w.alias("w"))
    hi = F.sum("w").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, 0))
    return cut_lineage(j.select(source, "n", "w", (hi - F.col("w")).alias("lo"), hi.alias("hi")), "weights")


def _estimate_draws(weights: DataFrame, stop: str) -> int:
    """Draws that very likely reach the stopping point: the expected number and six deviations."""
    p = F.col("w") / F.sum("w").over(Window.partitionBy())
    need = (F.col("n") + 1) / p * 1.2 + 6 * F.sqrt((F.col("n") + 1) * (1 - p)) / p + 16
    pick = F.min if stop == "first_exhausted" else F.max
    return int(weights.select(need.alias("x")).agg(pick("x")).first()[0])


def draw_table(spark: SparkSession, n_draws: int, weights: DataFrame, seed, source: str) -> DataFrame:
    """``range(n_draws)`` with the source whose range holds ``floor(u * W)``, its length and ``k``,
    the 1-based running count of draws of that source."""
    total = weights.agg(F.max("hi")).first()[0] or 0
    bin_of: Column = F.floor(F.col("x") * F.lit(BINS) / F.lit(float(max(total, 1)))).cast("long")
    spans = weights.withColumn("x", F.col("lo")).withColumn("b0", bin_of).withColumn("x", F.col("hi")).withColumn("b1", bin_of)
    spans = spans.select(source, F.col("n").alias("len"), "lo", "hi", F.explode(F.sequence("b0", "b1")).alias("bin"))
    d = spark.range(n_draws).select(F.col("id").alias("pos"), F.floor(hash_u52(seed, "id") * F.lit(total)).alias("x"))
    d = d.withColumn("bin", bin_of).join(broadcast_checked(spans, "weight_bins"), "bin").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    return two_phase_rank(d.select("pos", source, "len"), source, ["pos"], F.floor(F.col("pos") / F.lit(POS_BLOCK)), "k")


def interleave(
    indexed: DataFrame,
    source: str,
    rates: DataFrame,
    seed=42,
    stop: str = "first_exhausted",
    idx: str = "idx",
    sizes: DataFrame | None = None,
    max_rounds: int = 8,
) -> DataFrame:
    """Seeded interleave by rate with ``first_exhausted`` or ``all_exhausted`` stopping.

    ``indexed`` has ``source`` and a 0-based ``idx`` per source (see ``index_sources``);
    ``rates`` has a positive ``rate`` per source. Output: the source rows plus ``pos``.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(stop)
    spark = indexed.sparkSession
    weights = weight_table(sizes if sizes is not None else source_sizes(indexed, source), rates, source)
    sources = weights.count()
    n_draws = _estimate_draws(weights, stop) if sources else 0
    cut = 0
    for _ in range(max_rounds if sources else 0):
        draws = cut_lineage(draw_table(spark, n_draws, weights, seed, source), "draws")
        ends = draws.where(F.col("k") == F.col("len") + 1).groupBy(source).agg(F.min("pos").alias("e"))
        e = ends.agg(F.min("e").alias("first"), F.max("e").alias("last"), F.count(F.lit(1)).alias("n")).first()
        if stop == "first_exhausted" and e["n"]:
            cut = e["first"]
            break
        if stop == "all_exhausted" and e["n"] == sources:
            cut = e["last"]
            break
        n_draws *= 2
    else:
        if sources:
            raise RuntimeError("interleave: draw table did not reach the stopping point")
        return indexed.withColumn("pos", F.lit(None).cast("long")).limit(0)
    hits = draws.where(F.col("pos") < cut).select("pos", source, (F.pmod(F.col("k") - 1, F.col("len"))).alias(idx))
    return hits.join(indexed, [source, idx])


def draw_from_mixture(indexed: DataFrame, source: str, rates: DataFrame, n_rows: int, seed=42, idx: str = "idx", sizes: DataFrame | None = None) -> DataFrame:
    """``n_rows`` draws from a mixture by rate; a source that runs out starts again from its
    first row (examples repeat in proportion to the rate). Output: source rows plus ``pos``."""
    weights = weight_table(sizes if sizes is not None else source_sizes(indexed, source), rates, source)
    draws = draw_table(indexed.sparkSession, n_rows, weights, seed, source)
    hits = draws.select("pos", source, F.pmod(F.col("k") - 1, F.col("len")).alias(idx))
    return hits.join(indexed, [source, idx])
