"""Streaming classification.

``match`` (broadcast plan) and ``apply_threshold`` are stateless and
shuffle-free, so the same operators run on a streaming DataFrame: new files
are classified as they arrive against a static, broadcast reference set.  No
watermark or state store is needed.  The sink is Parquet with its own
checkpoint location so a restarted query resumes where it stopped.

A reference above the broadcast budget needs the blocked plan, which shuffles:
``classify_batches`` runs it on every micro-batch and writes each batch to a
folder of its own, so that a batch that is run again replaces its first output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semcode.operators import match as M


def classify_stream(stream: DataFrame, reference: DataFrame, threshold: float, *,
                    key: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """Streaming DataFrame of classified rows (append mode)."""
    return M.apply_threshold(M.match(stream, reference, key=key, vec=vec), threshold)


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream of its files: one file, or the part files of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, schema)
    folder, name = path.rsplit("/", 1)
    return file_stream(spark, folder, schema, glob=name)


def output(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """The table that a finished run has written; empty if no file had arrived."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out_path)


def run_available(df: DataFrame, out_path: str, checkpoint_path: str, name: str | None = None) -> None:
    """Process everything available now, append to Parquet, then stop."""
    w = (df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append")
         .trigger(availableNow=True))
    if name:
        w = w.queryName(name)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def classify_batches(stream: DataFrame, reference: DataFrame, threshold: float, out_path: str, checkpoint_path: str, *,
                     key: str = "doc_id", vec: str = "embedding", columns: list[str] | None = None,
                     max_broadcast_bytes: int = M.DEFAULT_BROADCAST_BYTES, block_bytes: int = M.DEFAULT_BLOCK_BYTES) -> None:
    """Classify everything available now against a reference of any size; read
    ``out_path`` as one Parquet table (partition column ``batch``)."""
    def one(batch: DataFrame, number: int) -> None:
        matches = M.match(batch, reference, key=key, vec=vec, max_broadcast_bytes=max_broadcast_bytes, block_bytes=block_bytes)
        out = M.apply_threshold(matches, threshold)
        out.select(*(columns or out.columns)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        M.release(matches)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
