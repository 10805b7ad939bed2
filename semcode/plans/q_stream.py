"""Queries: the embedding corpus classified by Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcode.plans import inputs as I
from semcode.plans.q_match import PRED_SQL
from semcode.plans.registry import register, r9
from semcode.session import scratch_path
from semcode.streaming import classify_stream as CS


STREAM_SQL = f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class, round(similarity_score, 9) AS similarity_score FROM pred"""


SCHEMA = "doc_id long, true_label string, predicted_class string, similarity_score double"
COLUMNS = ["doc_id", "true_label", "predicted_class", "similarity_score"]


def _stream(spark, sf_dir):
    schema = I.table(spark, sf_dir, "embeddings").schema
    return (CS.table_stream(spark, f"{sf_dir}/embeddings.parquet", schema)
            .where(~I.is_reference("vec_id"))
            .select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("true_label"), "embedding"))


@register("stream_classify", STREAM_SQL)
def q_stream_classify(spark, sf_dir):
    """Files of ``embeddings`` read as a stream (availableNow), classified
    against the broadcast reference, appended to Parquet in the shared
    checkpoint folder; the result is read back as a table."""
    stream = _stream(spark, sf_dir)
    out = CS.classify_stream(stream, I.embedding_reference(spark, sf_dir), I.THRESHOLD)
    base = scratch_path(spark, "stream-classify")
    CS.run_available(out.select(*COLUMNS), base + "/out", base + "/state")
    res = CS.output(spark, base + "/out", SCHEMA)
    return res.select("doc_id", "true_label", "predicted_class", r9("similarity_score").alias("similarity_score"))


@register("stream_classify_batches", STREAM_SQL)
def q_stream_classify_batches(spark, sf_dir):
    """The same stream against a reference that is never broadcast: each
    micro-batch meets the reference in blocks."""
    base = scratch_path(spark, "stream-batches")
    CS.classify_batches(_stream(spark, sf_dir), I.embedding_reference(spark, sf_dir), I.THRESHOLD, base + "/out", base + "/state",
                        columns=COLUMNS, max_broadcast_bytes=0)
    return CS.output(spark, base + "/out", SCHEMA).select("doc_id", "true_label", "predicted_class",
                                                          r9("similarity_score").alias("similarity_score"))
