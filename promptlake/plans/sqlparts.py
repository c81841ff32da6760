"""DuckDB SQL fragments used by the oracle queries (the same contracts as the Spark columns)."""

from __future__ import annotations

from ..functions.hashing import hash_u_sql
from ..sources.tables import CORPUS_SQL, LABELLED_SQL  # noqa: F401

WS = "[ \\t\\n\\r\\f\\x0B]"


def U(seed_sql: str, key_sql: str) -> str:
    return hash_u_sql(seed_sql, key_sql)


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def CLEAN(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_.]+', '_', 'g')"


def TASK(d: str, s: str, t: str) -> str:
    return CLEAN(f"(CASE WHEN {s} IS NULL THEN {d} || '_' || {t} ELSE {d} || '_' || {s} || '_' || {t} END)")


def NL() -> str:
    return "chr(10)"


def JOIN_INTS(x: str) -> str:
    """array<int> -> 'a b c' (arrays are compared as strings)."""
    return f"array_to_string({x}, ' ')"
