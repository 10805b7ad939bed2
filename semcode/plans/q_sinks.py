"""Queries: sinks and exports, written to and read back from the shared
checkpoint folder (directory outputs written by the executors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcode.operators import evaluate as E
from semcode.operators import match as M
from semcode.operators import topics as TP
from semcode.plans import inputs as I
from semcode.plans import q_encode as QE
from semcode.plans import q_topics as QT
from semcode.plans.q_evaluate import CELLS_SQL
from semcode.plans.q_match import PRED_SQL, thresholded
from semcode.plans.registry import register, r6, r9
from semcode.session import scratch_path
from semcode.sources import sinks as SK


def _csv_round_trip(spark, df, name):
    path = scratch_path(spark, name)
    SK.save_results(df, path, fmt="csv")
    return SK.read_results(spark, path, df.schema, fmt="csv")


@register("save_results", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class, matched_node, round(similarity_score, 9) AS similarity_score FROM pred""")
def q_save_results(spark, sf_dir):
    df = thresholded(spark, sf_dir).select("doc_id", "true_label", "predicted_class", "matched_node",
                                           "similarity_score")
    back = _csv_round_trip(spark, df, "results")
    return back.select("doc_id", "true_label", "predicted_class", "matched_node",
                       r9("similarity_score").alias("similarity_score"))


@register("save_reference_set", f"""WITH {I.EMB_SQL}
SELECT ref_id, class, node, CAST(len(v) AS INTEGER) AS n_dims, round(list_sum(v), 6) AS sum_embedding FROM ref""")
def q_save_reference_set(spark, sf_dir):
    path = scratch_path(spark, "reference-set")
    SK.save_reference_set(I.embedding_reference(spark, sf_dir), path)
    back = SK.load_reference_set(spark, path)
    return back.select("ref_id", "class", "node", F.size("embedding").alias("n_dims"),
                       r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("sum_embedding"))


@register("export_class_metrics", f"""WITH {CELLS_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m_pc""")
def q_export_class_metrics(spark, sf_dir):
    per = E.per_class(E.confusion(thresholded(spark, sf_dir)))
    back = _csv_round_trip(spark, per, "class-metrics")
    return back.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("export_predictions", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, predicted_class, round(similarity_score, 9) AS similarity_score FROM pred""")
def q_export_predictions(spark, sf_dir):
    df = thresholded(spark, sf_dir).select("doc_id", "predicted_class", "similarity_score")
    back = _csv_round_trip(spark, df, "predictions")
    return back.select("doc_id", "predicted_class", r9("similarity_score").alias("similarity_score"))


@register("export_classified", f"""WITH {QE.DOC_MATCH_SQL}
SELECT doc_id, predicted_class AS "Predicted Tag", round(similarity_score, 4) AS "Cosine Similarity Score",
       md5(matched_node) AS "Matched Reference Sentence md5" FROM dpred""")
def q_export_classified(spark, sf_dir):
    from semcode.plans import classify as C
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.classify_rounded(docs, I.doc_reference(spark, sf_dir), QE.DOC_T).drop("text")
    back = _csv_round_trip(spark, out, "classified")
    return back.select("doc_id", "Predicted Tag", "Cosine Similarity Score",
                       F.md5("Matched Reference Sentence").alias("Matched Reference Sentence md5"))


@register("export_topic_table", f"""WITH {QT.MODELLED_SQL}
SELECT doc_id, cluster, has_topic, md5(text) AS sentence_md5 FROM modelled""")
def q_export_topic_table(spark, sf_dir):
    """The topic table through CSV; whether a sentence has a topic is checkable
    in SQL, which topic it has depends on the fitted model."""
    back = _csv_round_trip(spark, QT._table(spark, sf_dir).select("doc_id", "cluster", "topic", "sentence"), "topic-table")
    return back.select("doc_id", "cluster", (F.col("topic") != TP.NO_TOPIC).alias("has_topic"),
                       F.md5("sentence").alias("sentence_md5"))


@register("cosine_pairs", f"""WITH {I.EMB_SQL}
SELECT doc_id, list(round(s, 9) ORDER BY ref_id) AS similarities FROM sim WHERE doc_id % 100 = 0 GROUP BY doc_id""")
def q_cosine_pairs(spark, sf_dir):
    """Similarity rows of a stated query set (ids divisible by 100) against all
    references, one array per text in ref_id order."""
    queries = I.embedding_corpus(spark, sf_dir).where("doc_id % 100 = 0")
    m = M.match(queries, I.embedding_reference(spark, sf_dir), keep_all=True)
    return m.select("doc_id", F.transform("all_similarities", lambda x: F.round(x, 9)).alias("similarities"))
