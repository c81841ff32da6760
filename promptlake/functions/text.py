"""Scalar text helpers shared by templates, tasks and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class stripped by `strip` (ASCII whitespace, as both Java
# regex and RE2 understand it when spelled out).
WS = "[ \\t\\n\\r\\f\\x0B]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing whitespace (Spark's `trim` only removes spaces)."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def task_clean(c) -> Column:
    """Every run of characters other than letters, digits, `_` and `.` becomes `_`."""
    return F.regexp_replace(_col(c), "[^\\p{L}\\p{N}_.]+", "_")


def task_name(dataset, subset, template) -> Column:
    """`dataset_subset_template`, or `dataset_template` without a subset, cleaned."""
    d, s, t = _col(dataset), _col(subset), _col(template)
    raw = F.when(s.isNull(), F.concat(d, F.lit("_"), t)).otherwise(F.concat(d, F.lit("_"), s, F.lit("_"), t))
    return task_clean(raw)


def zero_pad(c, width: int) -> Column:
    return F.lpad(_col(c).cast("string"), width, "0")
