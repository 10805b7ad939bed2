"""Threshold sweep in one pass over the data.

The best reference of a text does not depend on the threshold; only the
"Other" cut does.  So the corpus is matched once, each score is bucketed by
the number of grid points it reaches, and the data is reduced to
``(true_class, best_class, bucket, n)`` — one partial+final aggregate whose
size is bounded by classes² x grid points.  At grid index j a text keeps its
best class iff ``bucket > j``; expanding the small cell table over the grid
gives the confusion table of every threshold at once, and the metric code of
``evaluate`` scores them all together.  Bootstrap intervals draw the cell
table per iteration and reuse the same expansion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semcode.functions.vectors import round_score
from semcode.operators import bootstrap as B
from semcode.operators import evaluate as E
from semcode.operators.match import OTHER

CELL_COLS = ["true_class", "best_class", "bucket"]


def threshold_grid(start: float = 0.0, end: float = 1.0, step: float = 0.01) -> list[float]:
    """The reference's ``arange(start, end + step/2, step)`` grid, rounded to
    10 decimals.  Points a hair above 1 become 1; points beyond 1 are dropped
    (the reference would raise there)."""
    if not 0 <= start < end <= 1:
        raise ValueError("Threshold range must be between 0 and 1")
    if step <= 0:
        raise ValueError("step must be positive")
    pts = []
    for i in range(len(np.arange(start, end + step / 2, step))):
        t = round(start + i * step, 10)
        if t > 1 and t - 1 <= 1e-9:
            t = 1.0
        if t <= 1:
            pts.append(t)
    return pts


def grid_frame(spark, grid) -> DataFrame:
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)],
                                 "threshold_idx int, threshold double")


def bucketed(matches: DataFrame, grid, true_col="true_label", class_col="best_class",
             score_col="similarity_score", key="doc_id") -> DataFrame:
    """Per-row bucket = number of grid points <= score (rows without a score or
    a true label are left out)."""
    pts = F.array(*[F.lit(float(t)) for t in grid])
    s = round_score(F.col(score_col))
    return (matches.where(F.col(score_col).isNotNull() & F.col(true_col).isNotNull())
            .select(F.col(true_col).cast("string").alias("true_class"),
                    F.col(class_col).cast("string").alias("best_class"),
                    F.size(F.filter(pts, lambda t: t <= s)).alias("bucket"),
                    *([F.col(key)] if key in matches.columns else [])))


def sweep_cells(matches: DataFrame, grid, **kw) -> DataFrame:
    """``(true_class, best_class, bucket, n)`` — the only pass over the data."""
    return bucketed(matches, grid, **kw).groupBy(*CELL_COLS).agg(F.count(F.lit(1)).alias("n"))


def expand(cells: DataFrame, m: int, group_cols=(), at: int | None = None) -> DataFrame:
    """Confusion cells of every grid index (or of ``at`` alone): ``(group...,
    threshold_idx, true_class, predicted_class, n)``."""
    j = F.lit(at) if at is not None else F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    j = j.alias("threshold_idx")
    ex = cells.select(*group_cols, *CELL_COLS, "n", j)
    pred = F.when(F.col("bucket") > F.col("threshold_idx"), F.col("best_class")).otherwise(F.lit(OTHER))
    return (ex.groupBy(*group_cols, F.col("threshold_idx").cast("int").alias("threshold_idx"),
                       "true_class", pred.alias("predicted_class"))
            .agg(F.sum("n").cast("bigint").alias("n")))


def sweep(matches: DataFrame, start=0.0, end=1.0, step=0.01, **kw):
    """(curve, class_distribution): four metrics and predicted-class counts
    per threshold, from one pass."""
    spark = matches.sparkSession
    grid = threshold_grid(start, end, step)
    cells = expand(sweep_cells(matches, grid, **kw), len(grid))
    curve = (E.summary(cells, ["threshold_idx"]).join(F.broadcast(grid_frame(spark, grid)), "threshold_idx")
             .select("threshold_idx", "threshold", *E.METRICS))
    dist = (cells.groupBy("threshold_idx", F.col("predicted_class").alias("class"))
            .agg(F.sum("n").cast("bigint").alias("n")))
    return curve, dist


def optimum(curve: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """First maximum of ``metric`` (lowest threshold on ties)."""
    if metric not in E.METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    return (curve.orderBy(F.desc(F.round(metric, 9)), F.asc("threshold_idx")).limit(1)
            .withColumn("optimized_metric", F.lit(metric)))


def sweep_intervals(matches: DataFrame, start=0.0, end=1.0, step=0.01, n_iterations: int = 100,
                    level: float = 0.95, seed: int = 0, method: str = "cells", key: str = "doc_id",
                    at: int | None = None, cells: DataFrame | None = None, **kw) -> DataFrame:
    """``(threshold_idx, metric, level, lower, upper)``: the same resampled rows
    are used for every threshold (one draw per iteration).  ``at`` scores one
    grid index only; ``cells`` takes sweep cells that are already there."""
    grid = threshold_grid(start, end, step)
    if method == "cells":
        drawn = B.draw_cells(sweep_cells(matches, grid, **kw) if cells is None else cells, CELL_COLS, n_iterations, seed)
    elif method == "rows":
        drawn = B.draw_rows(bucketed(matches, grid, key=key, **kw), key, CELL_COLS, n_iterations, seed)
    else:
        raise ValueError(f"Unknown bootstrap method: {method}")
    cells = expand(drawn, len(grid), ["iteration"], at)
    reps = B.long_metrics(E.summary(cells, ["iteration", "threshold_idx"]), ["iteration", "threshold_idx"])
    return B.intervals(reps, [level], ["threshold_idx"])


def optimization_curve(curve: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Long ``(threshold_idx, threshold, metric, value, is_optimal)``."""
    if metric not in E.METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    # the curve has one row per grid point, so this global window is tiny
    first = F.first("threshold_idx").over(
        Window.orderBy(F.desc(F.round(metric, 9)), F.asc("threshold_idx"))
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    flagged = curve.withColumn("is_optimal", F.col("threshold_idx") == first)
    return flagged.unpivot(["threshold_idx", "threshold", "is_optimal"], list(E.METRICS), "metric", "value")


def top_class_curves(dist: DataFrame, grid_size: int, top_n: int = 10) -> DataFrame:
    """Counts of the ``top_n`` classes (by total over all thresholds, ties by
    name) at every threshold, zero-filled: ``(threshold_idx, class, n)``."""
    top = (dist.groupBy("class").agg(F.sum("n").alias("_tot"))
           .orderBy(F.desc("_tot"), F.asc("class")).limit(top_n)
           .select("class", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("threshold_idx")))
    return (top.join(dist, ["threshold_idx", "class"], "left")
            .select(F.col("threshold_idx").cast("int").alias("threshold_idx"), "class",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
