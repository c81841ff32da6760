"""Helpers for higher-order array functions.

Catalyst may collapse a projection into the next one and inline a column's expression at each
reference. A reference inside a lambda body is evaluated once per array element, so an
inlined ``split(...)`` or ``map(...)`` referenced there turns a linear expression into a
quadratic one. ``let`` binds a value once per row as a lambda variable: references inside the
body are variable lookups, whatever the optimizer does with the projection below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(v)`` with ``v`` = ``value`` evaluated once (``element_at(transform(array(value), body), 1)``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Two bindings at once (packed in a struct)."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))
