"""Label validation and class-set operations (distinct + anti/semi joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distinct_classes(reference: DataFrame, class_col: str = "class") -> DataFrame:
    return reference.select(F.col(class_col).cast("string").alias("class")).where(
        F.col("class").isNotNull()).distinct()


def unknown_labels(labeled: DataFrame, reference: DataFrame, label_col: str = "label",
                   class_col: str = "class") -> DataFrame:
    """Labels that are not reference classes (nulls are reported apart)."""
    labels = labeled.select(F.col(label_col).cast("string").alias("label")).where(
        F.col("label").isNotNull()).distinct()
    classes = distinct_classes(reference, class_col).withColumnRenamed("class", "label")
    return labels.join(classes, "label", "left_anti")


def validate_labels(labeled: DataFrame, reference: DataFrame, label_col: str = "label",
                    class_col: str = "class") -> DataFrame:
    """One row: ``is_valid`` (labels ⊆ classes), ``n_unknown`` distinct unknown
    labels, ``n_null_labels`` rows without a label."""
    unk = unknown_labels(labeled, reference, label_col, class_col).agg(
        F.count(F.lit(1)).alias("n_unknown"))
    nulls = labeled.agg(F.count_if(F.col(label_col).isNull()).alias("n_null_labels"))
    return (unk.withColumn("_g", F.lit(0)).join(nulls.withColumn("_g", F.lit(0)), "_g")
            .select((F.col("n_unknown") == 0).alias("is_valid"), "n_unknown", "n_null_labels"))


def labels_are_valid(labeled: DataFrame, reference: DataFrame, label_col: str = "label",
                     class_col: str = "class") -> bool:
    return unknown_labels(labeled, reference, label_col, class_col).isEmpty()


def common_labels(labeled: DataFrame, reference: DataFrame, label_col: str = "label",
                  class_col: str = "class") -> DataFrame:
    """One row: distinct classes in the reference, in the labels, and in both."""
    classes = distinct_classes(reference, class_col)
    labels = distinct_classes(labeled, label_col)
    both = classes.intersect(labels)
    c = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_g", F.lit(0))
    return (c(classes, "n_reference").join(c(labels, "n_labeled"), "_g")
            .join(c(both, "n_common"), "_g").drop("_g"))


def class_index(reference: DataFrame, key: str = "ref_id", class_col: str = "class") -> DataFrame:
    """Class -> 0-based index in order of first appearance (lowest key).
    The window runs over distinct classes only."""
    first = reference.groupBy(F.col(class_col).cast("string").alias("class")).agg(F.min(key).alias("_first"))
    return first.select("class", (F.row_number().over(Window.orderBy("_first", "class")) - 1).alias("class_idx"))
