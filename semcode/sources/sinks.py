"""Sinks.  Output is a directory of part files written by the executors in
parallel (never gathered on the driver); Parquet keeps array columns, CSV
needs flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semcode.sources.tables import ZSTD, csv_reader


def save_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by=None, compression: str | None = None) -> None:
    """``compression`` names the codec of the part files, which ``csv_reader`` knows by
    their extension; by default it is the format's own (none for CSV)."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", ZSTD if (fmt, compression) == ("csv", "zstd") else compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def read_results(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """What ``save_results`` wrote, with its types; in CSV a missing field is null
    and a quoted empty one is ""."""
    if fmt == "csv":
        return csv_reader(spark).schema(schema).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def save_reference_set(reference: DataFrame, path: str) -> None:
    """Persist an embedded reference set (``ref_id, class, node, embedding``)."""
    reference.write.mode("overwrite").parquet(path)


def load_reference_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
