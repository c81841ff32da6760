"""Ranks and running sums in key order over groups of any size.

A window over a group sends the whole group to one task. Here the rows are dealt once by ranges of
(group, key), whose bounds Spark samples, and sorted within the ranges, so a large group is spread
over as many tasks as it fills and a range may hold many small groups. What a row has before it in
its own range is known in that pass; the ranges are written, so that these numbers stand, and a table
with one row per group and range gives what the ranges before it hold. A row costs the same however
many ranges there are: it is compared with their bounds by binary search, and meets one offset.

Groups that fit one task (``ROWS_PER_TASK``, counted first) take a plain window, which is one exchange
less; results are the same. The key must order each group totally; null groups are a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import broadcast_checked

# Fixed value: rows of a group that one task sorts and numbers.
ROWS_PER_TASK = 1 << 20
_PART, _BEFORE, _FIRST, _OFFSET = "__part", "__before", "__first", "__offset"


def _fits_one_task(df: DataFrame, group: list[str], rows: int) -> bool:
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= rows


def _with_offsets(parts: DataFrame, group: list[str], total: Column, out: str) -> DataFrame:
    """``out``: what is before a row in its range, plus what the ranges before hold of its group."""
    heads = parts.groupBy(*group, _PART).agg(F.min(_BEFORE).alias(_FIRST), total.alias("__total"))
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn(_OFFSET, F.coalesce(F.sum("__total").over(before), F.lit(0)) - F.col(_FIRST))
    own = [F.col(c).alias(f"__{i}") for i, c in enumerate([*group, _PART])]
    heads = broadcast_checked(heads.select(*own, _OFFSET), "range_offsets")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*group, _PART])])
    return parts.join(heads, same).withColumn(out, (F.col(_BEFORE) + F.col(_OFFSET)).cast("long")).drop(_PART, _BEFORE, _OFFSET, *[f"__{i}" for i in range(len(group) + 1)])


def _dealt(df: DataFrame, group: list[str], order: list[str], ranges: int | None) -> DataFrame:
    by = [*group, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def _listed(cols: Sequence[str] | str | None) -> list[str]:
    return [] if cols is None else [cols] if isinstance(cols, str) else list(cols)


def ordered_rank(df: DataFrame, group: Sequence[str] | str | None, order: Sequence[str] | str, out: str = "rn", ranges: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """1-based ``row_number() over (partition by group order by order)``; ``ranges``: how many, by default the shuffle partitions."""
    g, by = _listed(group), _listed(order)
    if _fits_one_task(df, g, rows_per_task):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*g).orderBy(*by)).cast("long"))
    # the id counts the rows of a range from zero and holds the number of the range above bit 33
    at = F.monotonically_increasing_id()
    parts = cut_lineage(_dealt(df, g, by, ranges).withColumn("__at", at), "ranges")
    parts = parts.withColumn(_PART, F.shiftright("__at", 33)).withColumn(_BEFORE, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")
    return _with_offsets(parts, g, F.count(F.lit(1)), out).withColumn(out, F.col(out) + 1)


def _running(value: str):
    """Sum of ``value`` over the rows before each row of a task's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = seen + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - x)], names=[*batch.schema.names, _BEFORE])
            seen = int(upto[-1]) if len(x) else seen

    return run


def ordered_cumsum(df: DataFrame, group: Sequence[str] | str | None, order: Sequence[str] | str, value: str, out: str, ranges: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exclusive running sum of a whole, non-negative ``value`` per group in order; null counts as 0."""
    g, by = _listed(group), _listed(order)
    if _fits_one_task(df, g, rows_per_task):
        before = Window.partitionBy(*g).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))
    dealt = _dealt(df, g, by, ranges).withColumn(_PART, F.spark_partition_id())
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    parts = cut_lineage(dealt.mapInArrow(_running(value), f"{shape}, {_BEFORE} long"), "ranges")
    return _with_offsets(parts, g, F.coalesce(F.sum(value), F.lit(0)), out)
