"""Ranks and running sums over sampled ranges: hot groups, null groups, outliers, very many ranges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from promptlake.operators.ordered import ordered_cumsum, ordered_rank

RANGES = [(None, 1 << 20), (None, 10), (7, 10), (2000, 10)]


def _rows():
    r = random.Random(4)
    keys = r.sample(range(-(1 << 60), 1 << 60), 3000)
    groups = ["hot" if i % 3 else f"g{i % 50}" for i in range(2990)] + [None] * 10
    return [(g, k, None if r.random() < 0.05 else r.randrange(1 << 33)) for g, k in zip(groups, keys, strict=True)] + [("g0", (1 << 62), 5)]


def _want(rows):
    rank, before, by = {}, {}, {}
    for g, k, v in sorted(rows, key=lambda x: x[1]):
        n, s = by.get(g, (0, 0))
        rank[g, k], before[g, k] = n + 1, s
        by[g] = (n + 1, s + (v or 0))
    return rank, before


@pytest.mark.parametrize(("ranges", "rows_per_task"), RANGES)
def test_rank_and_running_sum(spark, ranges, rows_per_task):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    rank, before = _want(rows)
    got = ordered_rank(df, "g", "k", "rn", ranges, rows_per_task)
    assert got.columns == ["g", "k", "v", "rn"] and {(x.g, x.k): x.rn for x in got.collect()} == rank
    got = ordered_cumsum(df, ["g"], ["k"], "v", "s", ranges, rows_per_task)
    assert got.columns == ["g", "k", "v", "s"] and {(x.g, x.k): x.s for x in got.collect()} == before


def test_no_group_and_empty_table(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    assert all(x.rn == x.k + 1 for x in ordered_rank(df, None, "k", "rn", 40, 10).collect())
    assert all(x.s == x.k * (x.k - 1) // 2 for x in ordered_cumsum(df, None, "k", "k", "s", 40, 10).collect())
    assert ordered_rank(df.limit(0), None, "k", "rn", 40, -1).count() == 0 and ordered_cumsum(df.limit(0), None, "k", "k", "s", 40, -1).count() == 0


def test_an_outlier_and_ties_of_groups_do_not_fill_one_range(spark):
    rows = [("a", float(i)) for i in range(1000)] + [("a", 1e300)] + [("b", float(i)) for i in range(20)]
    got = ordered_rank(spark.createDataFrame(rows, "g string, v double").repartition(4), "g", "v", "rn", 10, 100)
    assert {(x.g, x.v): x.rn for x in got.collect()} == {**{("a", v): i + 1 for i, v in enumerate([float(i) for i in range(1000)] + [1e300])}, **{("b", float(i)): i + 1 for i in range(20)}}


def test_rows_meet_one_offset_whatever_the_number_of_ranges(spark):
    """The final plan is a hash join with one row per group and range: no expression over the bounds."""
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    plan = ordered_rank(df, "g", "k", "rn", 2000, 10)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and not re.search("lambda|filter\\(|Window \\[row_number|NestedLoop|Cartesian", plan)
    widths = [len(ordered_rank(df, "g", "k", "rn", n, 10)._jdf.queryExecution().optimizedPlan().toString()) for n in (20, 2000)]
    assert abs(widths[0] - widths[1]) < 200
