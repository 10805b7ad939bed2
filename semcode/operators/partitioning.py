"""Parallelism guard for CPU-heavy per-row stages (tokenising, hashing,
encoding).

A large input already arrives in many scan splits and this is a no-op.  A
small input held in one file row group would otherwise be tokenised by a
single task; then the rows are hash-partitioned on their key across the
cluster's default parallelism (deterministic on retry, and later
aggregations on the key can reuse the partitioning).

Only plain scans are spread: asking a plan with exchanges for its partitions
would run those exchanges.  Spread a table before joining it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    try:
        if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()  # a narrow plan: this runs no job
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Spark Connect session): leave as is
        return df
    if current >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
