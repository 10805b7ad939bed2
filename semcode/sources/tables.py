"""Table scans.  Loading stays lazy: the only eager work is a schema check
(free — it reads the footer / header) and, on request, one aggregate that
counts rows and nulls in a single pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: stands for a missing CSV field while reading, so that a quoted "" stays ""
MISSING = "\u0000missing"
#: zstd for text files: the codec that comes with Spark's Parquet needs no native Hadoop library
ZSTD = "org.apache.parquet.hadoop.codec.ZstandardCodec"


def csv_reader(spark: SparkSession, multi_line: bool = True):
    """Quoted CSV with a header; only fields without any character are null.
    ``multi_line=False`` lets one large file be read by many tasks."""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
            .option("escape", '"').option("nullValue", MISSING).option("io.compression.codecs", ZSTD))


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               null_values: tuple[str, ...] = ("",), multi_line: bool = True) -> DataFrame:
    """Parquet by default; CSV (header, quoted fields) by extension.

    CSV: missing fields are null, and so are the texts in ``null_values`` (by
    default the empty one; pandas would also turn ``NA``/``nan`` into null).
    Columns are read as strings: no schema inference pass over the data.
    Fields that span lines need ``multi_line`` (one task per file).
    """
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        df = csv_reader(spark, multi_line).csv(path)
        if null_values:
            df = df.select(*[F.when(F.col(f"`{c}`").isin(*null_values), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                             for c in df.columns])
        return df
    return spark.read.format(fmt).load(path)


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns {missing} not found in the input.")


def null_report(df: DataFrame, columns) -> DataFrame:
    """One row: ``n_rows`` and ``nulls_<col>`` for each named column."""
    require_columns(df, columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns])


def load_corpus(spark: SparkSession, path: str, sentence_column: str = "sentence", **kw) -> DataFrame:
    df = read_table(spark, path, **kw)
    require_columns(df, [sentence_column])
    return df


def load_reference(spark: SparkSession, path: str, class_column: str = "class",
                   node_column: str = "matching_node", **kw) -> DataFrame:
    df = read_table(spark, path, **kw)
    require_columns(df, [class_column, node_column])
    return df


def load_labeled(spark: SparkSession, path: str, label_column: str = "label", **kw) -> DataFrame:
    df = read_table(spark, path, **kw)
    require_columns(df, [label_column])
    return df


def reference_summary(df: DataFrame, class_column: str = "class", node_column: str = "matching_node") -> DataFrame:
    """Rows, distinct classes (nulls excluded) and whether any class/node is null."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.countDistinct(class_column).alias("n_classes"),
                  (F.count_if(F.col(class_column).isNull() | F.col(node_column).isNull()) > 0)
                  .alias("has_nulls"))


def label_distribution(df: DataFrame, label_column: str = "label") -> DataFrame:
    """Rows per label, largest first."""
    return (df.groupBy(F.col(label_column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("label")))
