"""Bootstrap confidence intervals for the classification metrics.

A replicate draws n rows with replacement and re-scores them.  Metrics only
depend on the replicate through its confusion counts, so two exact plans:

* ``method="cells"`` (default, scale-free): drawing n rows uniformly is
  exactly Multinomial(n, cell share) over the confusion cells.  It is drawn in
  two steps: the rows of each true class first (one number per class and
  iteration, from the class totals), then each class's cells, conditionally,
  one task per class and slice of iterations.  The work is cells x iterations,
  independent of the data size; the driver sees class totals only.
* ``method="rows"``: the literal resampling — draw j of iteration b picks row
  ``md5(seed:b:j) mod n`` of a dense, hash-ordered row index.  n x B rows, one
  shuffle join on the index; exact in SQL (the oracle checks it).

Randomness is keyed by (seed, iteration[, draw]), never by partition, so
results do not change with cluster size or after a task is retried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semcode.functions.hashing import U32, md5_u32, seeded_key
from semcode.operators import evaluate as E
from semcode.session import checkpoint_dir

INDEX_BUCKET_BITS = 16


def dense_index(df: DataFrame, key: str, out: str = "row_idx") -> DataFrame:
    """Add a dense 0..n-1 index ordered by (md5_u32(key), key) without a
    global sort: rows fall into 65,536 hash buckets, a running sum over the
    bucket counts (a 65,536-row table) gives each bucket's offset, and only
    rows within a bucket are ranked.  No bucket holds more than its hash share,
    whatever the key skew of other columns."""
    h = df.withColumn("_h", md5_u32(F.col(key))).withColumn(
        "_b", F.shiftright(F.col("_h"), 32 - INDEX_BUCKET_BITS))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn(
        "_off", F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_b", F.coalesce(F.col("_off"), F.lit(0)).alias("_off"))
    ranked = h.join(F.broadcast(offsets), "_b").withColumn(
        out, F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    return ranked.drop("_h", "_b", "_off")


def draw_rows(df: DataFrame, key: str, cell_cols, n_iterations: int, seed: int) -> DataFrame:
    """``(iteration, cell cols..., n)`` — literal resampling of the rows."""
    spark = df.sparkSession
    idx = dense_index(df.select(key, *cell_cols), key)
    n = idx.count()
    if n == 0:
        return spark.createDataFrame([], "iteration long")
    draws = (spark.range(0, n_iterations * n)
             .select(F.expr(f"id div {n}").alias("iteration"),
                     (F.col("id") % F.lit(n)).alias("draw")))
    if n >= U32:
        raise ValueError("the rows method draws 32-bit numbers; use method='cells' for tables of 2**32 rows or more")
    draws = draws.withColumn("row_idx", md5_u32(seeded_key(seed, "iteration", "draw")) % F.lit(n))
    return (draws.join(idx, "row_idx").groupBy("iteration", *cell_cols)
            .agg(F.count(F.lit(1)).alias("n")))


def draw_cells(cells: DataFrame, cell_cols, n_iterations: int, seed: int, count_col: str = "n") -> DataFrame:
    """``(iteration, cell cols..., n)`` — one multinomial draw per iteration.

    The first cell column is the true class.  Seeds depend on (seed, iteration)
    for the class totals and on (seed, iteration, class) for the cells."""
    spark = cells.sparkSession
    first = cell_cols[0]
    fixed = cells.select(*cell_cols, F.col(count_col).cast("long").alias("n"))
    totals = (fixed.groupBy(first).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).orderBy(first).collect())
    n = sum(r["n"] for r in totals)
    names = [r[first] for r in totals]
    shares = np.array([r["n"] / n for r in totals]) if n else np.zeros(len(totals))
    per_class = np.zeros((n_iterations, len(names)), np.int64)
    for it in range(n_iterations if n else 0):
        per_class[it] = np.random.default_rng([seed, it]).multinomial(n, shares)
    drawn = spark.sparkContext.broadcast({c: per_class[:, i] for i, c in enumerate(names)})
    # one task handles at most about a million (cell, iteration) numbers
    step = max(1, min(n_iterations, 1_000_000 // max(1, max((r["cells"] for r in totals), default=1))))
    slices = -(-n_iterations // step)
    schema = fixed.select(*cell_cols).schema.add("iteration", "long").add("n", "long")

    def draw(key, pdf):
        pdf = pdf.sort_values(list(cell_cols), kind="stable")
        p = (pdf["n"] / pdf["n"].sum()).to_numpy()
        want, name = drawn.value[key[0]], zlib.crc32(str(key[0]).encode())
        its = range(key[1] * step, min(n_iterations, (key[1] + 1) * step))
        k = np.stack([np.random.default_rng([seed, it, name]).multinomial(want[it], p) for it in its])
        i, j = np.nonzero(k)
        out = pdf[list(cell_cols)].iloc[j].reset_index(drop=True)
        out["iteration"], out["n"] = i + its.start, k[i, j]
        return out

    return (fixed.where("n > 0").withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            .groupBy(first, "__slice").applyInPandas(draw, schema).select("iteration", *cell_cols, "n"))


def bootstrap(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_class",
              n_iterations: int = 1000, levels=(0.9, 0.95, 0.99), seed: int = 0,
              method: str = "cells", key: str = "doc_id"):
    """(replicates, intervals with point estimates).  The confusion table is
    checkpointed once and feeds the class totals, the draws and the point
    estimate (so the predictions behind it are computed once)."""
    cells = E.confusion(df, true_col, pred_col)
    if method == "cells":
        checkpoint_dir(df.sparkSession)
        cells = cells.checkpoint(eager=True)
        drawn = draw_cells(cells, ["true_class", "predicted_class"], n_iterations, seed)
        reps = long_metrics(E.summary(drawn, ["iteration"]), ["iteration"])
    else:
        reps = replicates(df, true_col, pred_col, n_iterations, seed, method, key)
    return reps, intervals(reps, levels, point=E.summary(cells))


def replicates(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_class",
               n_iterations: int = 1000, seed: int = 0, method: str = "cells",
               key: str = "doc_id") -> DataFrame:
    """``(iteration, metric, value)`` — the four metrics of every replicate."""
    base = df.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull()).select(
        key, F.col(true_col).cast("string").alias("true_class"),
        F.col(pred_col).cast("string").alias("predicted_class"))
    if method == "rows":
        drawn = draw_rows(base, key, ["true_class", "predicted_class"], n_iterations, seed)
    elif method == "cells":
        drawn = draw_cells(E.confusion(base, "true_class", "predicted_class"),
                           ["true_class", "predicted_class"], n_iterations, seed)
    else:
        raise ValueError(f"Unknown bootstrap method: {method}")
    return long_metrics(E.summary(drawn, ["iteration"]), ["iteration"])


def long_metrics(summary: DataFrame, group_cols) -> DataFrame:
    """Wide metric columns to ``(group..., metric, value)``."""
    return summary.unpivot(list(group_cols), list(E.METRICS), "metric", "value")


def intervals(reps: DataFrame, levels=(0.9, 0.95, 0.99), group_cols=(),
              point: DataFrame | None = None) -> DataFrame:
    """Percentile intervals ``(group..., metric, level, lower, upper[, point])``
    with linear interpolation between order statistics (as numpy's default)."""
    qs = []
    for lv in levels:
        qs += [(1 - lv) / 2, 1 - (1 - lv) / 2]
    pct = reps.groupBy(*group_cols, "metric").agg(
        F.percentile(F.col("value"), F.array(*[F.lit(q) for q in qs])).alias("_q"))
    rows = []
    for i, lv in enumerate(levels):
        rows.append(pct.select(*group_cols, "metric", F.lit(float(lv)).alias("level"),
                               F.col("_q")[2 * i].alias("lower"), F.col("_q")[2 * i + 1].alias("upper")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    if point is not None:
        out = out.join(long_metrics(point, group_cols).withColumnRenamed("value", "point"),
                       [*group_cols, "metric"], "left")
    return out


def bounds_nested(iv: DataFrame, group_cols=()) -> DataFrame:
    """``(group..., metric, bounds_nested)``: every interval is ordered and holds
    the intervals of lower levels."""
    w = Window.partitionBy(*group_cols, "metric").orderBy("level")
    ok = ((F.col("lower") <= F.col("upper")) & (F.coalesce(F.lag("lower").over(w), F.col("lower")) >= F.col("lower"))
          & (F.coalesce(F.lag("upper").over(w), F.col("upper")) <= F.col("upper")))
    return iv.withColumn("_ok", ok).groupBy(*group_cols, "metric").agg(F.min("_ok").alias("bounds_nested"))


def histogram(reps: DataFrame, bins: int = 30) -> DataFrame:
    """``(metric, bin, bin_lower, bin_upper, n)`` — equal-width bins between the
    min and max of each metric; all-equal values land in bin 1."""
    rng = reps.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo"))
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width * F.lit(bins)) + 1, F.lit(bins)))
    return (reps.join(F.broadcast(rng), "metric").withColumn("bin", b.cast("int"))
            .groupBy("metric", "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
            .select("metric", "bin",
                    (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_lower"),
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_upper"),
                    "n"))
