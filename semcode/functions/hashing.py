"""Deterministic hashes that give the same number in Spark and in DuckDB.

``md5_u32(x)`` is the first 32 bits of md5(x) as a non-negative BIGINT.  It is
the random source of the exact samplers, the ``rows`` bootstrap and the hashed
text encoder: it depends only on the value, never on partitioning, so results
are reproducible on any cluster size and after executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296  # 2**32


def md5_u32(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_u32_sql(expr: str, dialect: str = "spark") -> str:
    """SQL text of the same hash; ``dialect='duckdb'`` for the oracle."""
    if dialect == "duckdb":
        return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"
    return f"CAST(conv(substr(md5(CAST({expr} AS STRING)), 1, 8), 16, 10) AS BIGINT)"


def seeded_key(seed: int, *parts: Column | str) -> Column:
    """``'<seed>:<p1>:<p2>…'`` — the string that is hashed for one draw."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"))
    return F.concat_ws(":", *cols)


def uniform01(seed: int, *parts: Column | str) -> Column:
    """A uniform number in [0, 1) drawn from md5(seed:parts)."""
    return md5_u32(seeded_key(seed, *parts)) / F.lit(float(U32))
