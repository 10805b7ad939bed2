"""Registered queries: one DataFrame-returning callable per operator of the
inventory, each with its DuckDB twin where the result is expressible in SQL.

Every query reads the driver tables in full (or data Spark derives from
them); numeric outputs are rounded to 6 decimals and counts are BIGINT so the
two engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = positive_zero_rounding(sql.strip())
        return fn
    return deco


def positive_zero_rounding(sql: str) -> str:
    """Rewrite every ``round(x, d)`` of the DuckDB text as ``(round(x, d) +
    0.0)``: DuckDB keeps the sign of a rounded tiny negative (-0.0) where
    Spark returns 0.0, and the two would hash differently."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounding(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r9(c):
    """Scores are decided on 9 decimals; they are reported on the same 9 so a
    second rounding cannot meet a half-way tie (which the two engines break
    differently)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9)
