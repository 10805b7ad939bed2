"""Preparation of raw inputs: renames, label clean-up, null handling, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from semcode.operators.match import OTHER


def rename_reference(df: DataFrame, tag_col: str = "tag", sentence_col: str = "sentence") -> DataFrame:
    """Raw coded examples (``tag``, ``sentence``) to ``class`` / ``matching_node``."""
    return df.withColumnsRenamed({tag_col: "class", sentence_col: "matching_node"})


def prepare_labels(df: DataFrame, raw_col: str = "Label", label_col: str = "label",
                   none_value: str = "0") -> DataFrame:
    """Rename the label column; on a STRING column the value ``'0'`` means
    "no code" and becomes ``"Other"``.  A numeric column is left as is (the
    string comparison is explicit: Spark would otherwise coerce ``0 = '0'``)."""
    out = df.withColumnRenamed(raw_col, label_col) if raw_col != label_col else df
    if isinstance(out.schema[label_col].dataType, T.StringType):
        c = F.col(label_col)
        out = out.withColumn(label_col, F.when(c == F.lit(none_value), F.lit(OTHER)).otherwise(c))
    return out


def other_count(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows now labelled ``"Other"`` (including rows that already were)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(label_col).cast("string") == F.lit(OTHER)).alias("n_other"))


def fill_empty_text(df: DataFrame, col: str = "sentence") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("")))


def drop_missing(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def cast_text(df: DataFrame, col: str = "sentence") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("string"))


def dataset_stats(df: DataFrame, class_col: str = "class") -> DataFrame:
    """One row: rows and distinct non-null classes."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(class_col).alias("n_classes"))


def class_shares(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Rows per class and their share, largest first."""
    total = F.sum("n").over(Window.partitionBy())  # over the per-class counts only
    counts = df.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.asc("class"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by key (a top-n, not a sort of the table)."""
    return df.orderBy(key).limit(n)
