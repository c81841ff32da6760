"""Reproducible per-row randomness.

Every random choice in the library is a pure function of (seed, key): the first 32 bits of
``md5(seed || ':' || key)`` read as an unsigned integer and divided by 2^32. The value does not
depend on partitioning, task order or engine (the same expression is written in DuckDB SQL by
the oracles), so a re-run after executor loss reproduces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_u(seed, key) -> Column:
    """Uniform double in [0, 1) from ``md5(seed:key)``; ``seed`` may be a literal or a Column."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    s = F.concat(seed_c.cast("string"), F.lit(":"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def hash_u_sql(seed_sql: str, key_sql: str) -> str:
    """The same uniform as a DuckDB SQL expression (used by the oracles)."""
    return (
        f"(('0x' || substr(md5(CAST({seed_sql} AS VARCHAR) || ':' || CAST({key_sql} AS VARCHAR)), 1, 8))"
        f"::UBIGINT::DOUBLE / 4294967296.0)"
    )


TWO_52 = 4503599627370496.0


def hash_u52(seed, key) -> Column:
    """Uniform double in [0, 1) from 52 bits of ``md5(seed:key)``: for ranges larger than 2^32."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    s = F.concat(seed_c.cast("string"), F.lit(":"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def hash_u52_sql(seed_sql: str, key_sql: str) -> str:
    """The same uniform as a DuckDB SQL expression (used by the oracles)."""
    return (
        f"(('0x' || substr(md5(CAST({seed_sql} AS VARCHAR) || ':' || CAST({key_sql} AS VARCHAR)), 1, 13))"
        f"::UBIGINT::DOUBLE / 4503599627370496.0)"
    )
