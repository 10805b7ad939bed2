"""Classification metrics from a confusion table.

Everything is derived from ``cells = (group..., true_class, predicted_class, n)``
— one partial+final hash aggregate over the data, after which the work is
bounded by classes² per group.  ``group`` is empty for a plain evaluation,
``iteration`` for bootstrap replicates and ``threshold_idx`` for the sweep, so
the same code scores one table, a thousand replicates or a grid of thresholds
in a single job.

Rules (as in the reference): macro averages run over the classes present in
truth or prediction *of that group*; undefined ratios are 0; a given class
list restricts the per-class table and the confusion matrix, not the macro
averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro")


def confusion(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_class",
              group_cols=(), weight_col: str | None = None) -> DataFrame:
    """``(group..., true_class, predicted_class, n)``; rows with a null true or
    predicted class are left out."""
    w = F.sum(weight_col).cast("bigint") if weight_col else F.count(F.lit(1))
    return (df.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull())
            .groupBy(*group_cols, F.col(true_col).cast("string").alias("true_class"),
                     F.col(pred_col).cast("string").alias("predicted_class"))
            .agg(w.alias("n")))


def class_counts(cells: DataFrame, group_cols=()) -> DataFrame:
    """``(group..., class, support, predicted, tp)`` for every class seen on
    either side.  Each cell contributes to its true and its predicted class
    through one ``explode`` (a single pass, no self-union)."""
    t, p, n = F.col("true_class"), F.col("predicted_class"), F.col("n").cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(t.alias("class"), n.alias("support"), zero.alias("predicted"),
                 F.when(t == p, n).otherwise(zero).alias("tp")),
        F.struct(p.alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))
    ex = cells.select(*group_cols, F.explode(sides).alias("_s")).select(*group_cols, "_s.*")
    return (ex.groupBy(*group_cols, "class")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("tp").alias("tp")))


def _ratios(df: DataFrame) -> DataFrame:
    tp, sup, pr = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    return df.withColumns({
        "precision": F.when(pr == 0, F.lit(0.0)).otherwise(tp / pr),
        "recall": F.when(sup == 0, F.lit(0.0)).otherwise(tp / sup),
        "f1": F.when(sup + pr == 0, F.lit(0.0)).otherwise(2.0 * tp / (sup + pr)),
    })


def per_class(cells: DataFrame, group_cols=(), classes=None) -> DataFrame:
    """``(group..., class, precision, recall, f1, support)``.  With ``classes``
    the table has exactly those classes (zeros for absent ones)."""
    counts = _ratios(class_counts(cells, group_cols))
    out = counts.select(*group_cols, "class", "precision", "recall", "f1", "support")
    if classes is None:
        return out
    listed = F.explode(F.array(*[F.lit(str(c)) for c in classes])).alias("class")
    if group_cols:
        wanted = cells.select(*group_cols).distinct().select(*group_cols, listed)
    else:
        wanted = cells.sparkSession.range(1).select(listed)
    return (wanted.join(out, [*group_cols, "class"], "left")
            .select(*group_cols, "class",
                    *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
                    F.coalesce(F.col("support"), F.lit(0)).cast("bigint").alias("support")))


def summary(cells: DataFrame, group_cols=()) -> DataFrame:
    """``(group..., accuracy, precision_macro, recall_macro, f1_macro, n_samples)``
    from one aggregation over the per-class table (hits = sum of tp, n = sum
    of support)."""
    per = _ratios(class_counts(cells, group_cols))
    agg = per.groupBy(*group_cols).agg(
        F.sum("support").cast("bigint").alias("n_samples"), F.sum("tp").alias("_hits"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))
    return agg.select(*group_cols, (F.col("_hits").cast("double") / F.col("n_samples")).alias("accuracy"),
                      "precision_macro", "recall_macro", "f1_macro", "n_samples")


def evaluate(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_class",
             classes=None):
    """(summary, per_class, confusion) for one labelled prediction table.

    ``classes`` defaults to the sorted union of true and predicted labels.
    """
    cells = confusion(df, true_col, pred_col)
    return summary(cells), per_class(cells, classes=classes), confusion_dense(cells, classes)


def label_union(cells: DataFrame) -> DataFrame:
    """Sorted union of true and predicted classes (one row per class)."""
    return (cells.select(F.col("true_class").alias("class"))
            .union(cells.select(F.col("predicted_class").alias("class"))).distinct().orderBy("class"))


def confusion_dense(cells: DataFrame, classes=None) -> DataFrame:
    """Long dense matrix over the class list: every (true, predicted) pair of
    listed classes, zero-filled; pairs with an unlisted class are dropped.

    The class list is bounded by the reference classes plus the truth labels,
    so the square is small and built from one aggregated row.
    """
    if classes is None:
        cls = label_union(cells).agg(F.array_sort(F.collect_list("class")).alias("cls"))
    else:
        cls = cells.sparkSession.createDataFrame([([str(c) for c in classes],)], "cls array<string>")
    square = (cls.select(F.explode("cls").alias("true_class"), "cls")
              .select("true_class", F.explode("cls").alias("predicted_class")))
    return (square.join(cells, ["true_class", "predicted_class"], "left")
            .select("true_class", "predicted_class", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def confusion_wide(dense: DataFrame, classes) -> DataFrame:
    """Display form: one row per true class, one column per predicted class."""
    return dense.groupBy("true_class").pivot("predicted_class", [str(c) for c in classes]).agg(F.first("n"))


def confusion_rows(dense: DataFrame) -> DataFrame:
    """Display form with fixed columns: ``(true_class, counts)``, counts in class order."""
    return (dense.groupBy("true_class")
            .agg(F.array_sort(F.collect_list(F.struct("predicted_class", "n"))).alias("_c"))
            .select("true_class", F.transform("_c", lambda x: x["n"]).alias("counts")))


def mark_correct(df: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_class") -> DataFrame:
    return df.withColumn("correct", F.col(pred_col).eqNullSafe(F.col(true_col)))


def filter_predictions(df: DataFrame, show: str = "all", true_col: str = "true_label",
                       pred_col: str = "predicted_class") -> DataFrame:
    """``show`` in {"all", "correct", "incorrect", "none"}."""
    ok = F.col(pred_col).eqNullSafe(F.col(true_col))
    if show == "correct":
        return df.where(ok)
    if show == "incorrect":
        return df.where(~ok)
    if show == "none":
        return df.where(F.lit(False))
    if show == "all":
        return df
    raise ValueError(f"Unknown filter: {show}")
