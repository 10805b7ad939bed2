"""Queries: matching and classification of the embedding corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.operators import match as M
from semcode.plans import inputs as I
from semcode.plans.registry import register, r6, r9

T = I.THRESHOLD


def best_matches(spark, sf_dir) -> DataFrame:
    return M.match(I.embedding_corpus(spark, sf_dir), I.embedding_reference(spark, sf_dir))


def thresholded(spark, sf_dir, t=T) -> DataFrame:
    return M.apply_threshold(best_matches(spark, sf_dir), t)


# ---------------------------------------------------------------- matching
@register("match_top1", f"""
WITH {I.EMB_SQL}
SELECT doc_id, best_ref_id, best_class, best_node, round(similarity_score, 9) AS similarity_score FROM best""")
def q_match_top1(spark, sf_dir):
    return best_matches(spark, sf_dir).select(
        "doc_id", "best_ref_id", "best_class", "best_node", r9("similarity_score").alias("similarity_score"))


@register("match_tree", f"""
WITH {I.EMB_SQL}
SELECT doc_id, best_ref_id, best_class, round(similarity_score, 9) AS similarity_score FROM best""")
def q_match_tree(spark, sf_dir):
    """The same winners by the plan for references above the broadcast budget."""
    m = M.match(I.embedding_corpus(spark, sf_dir), I.embedding_reference(spark, sf_dir), max_broadcast_bytes=0)
    return m.select("doc_id", "best_ref_id", "best_class", r9("similarity_score").alias("similarity_score"))


@register("similar_pairs", f"""
WITH {I.EMB_SQL}
SELECT doc_id, ref_id, class, round(s, 9) AS similarity FROM sim WHERE s >= {T}""")
def q_similar_pairs(spark, sf_dir):
    """Every corpus row and reference at or above the threshold."""
    p = M.similar_pairs(I.embedding_corpus(spark, sf_dir), I.embedding_reference(spark, sf_dir), T)
    return p.select("doc_id", "ref_id", "class", r9("similarity").alias("similarity"))


@register("similar_pair_classes", f"""
WITH {I.EMB_SQL}
SELECT true_label, class, count(*)::BIGINT AS n_pairs, count(DISTINCT doc_id)::BIGINT AS n_rows, round(avg(s), 6) AS avg_similarity
FROM sim WHERE s >= {T} GROUP BY 1, 2""")
def q_similar_pair_classes(spark, sf_dir):
    """The pairs by true label and reference class."""
    corpus = I.embedding_corpus(spark, sf_dir)
    p = M.similar_pairs(corpus, I.embedding_reference(spark, sf_dir), T)
    per = p.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"))
    return (per.join(corpus.select("doc_id", "true_label"), "doc_id").groupBy("true_label", "class")
            .agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_rows"), (F.sum("s") / F.sum("n")).alias("a"))
            .select("true_label", "class", "n_pairs", "n_rows", r6("a").alias("avg_similarity")))


PRED_SQL = f"""
pred AS (SELECT *, CASE WHEN similarity_score >= {T} THEN best_class ELSE 'Other' END AS predicted_class,
                   CASE WHEN similarity_score >= {T} THEN best_node ELSE '' END AS matched_node FROM best)"""


@register("match_threshold", f"""
WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, predicted_class, matched_node, round(similarity_score, 9) AS similarity_score FROM pred""")
def q_match_threshold(spark, sf_dir):
    return thresholded(spark, sf_dir).select(
        "doc_id", "predicted_class", "matched_node", r9("similarity_score").alias("similarity_score"))


@register("class_distribution", f"""
WITH {I.EMB_SQL}, {PRED_SQL}
SELECT predicted_class AS class, count(*)::BIGINT AS n FROM pred GROUP BY 1 ORDER BY n DESC, class""")
def q_class_distribution(spark, sf_dir):
    return M.class_distribution(thresholded(spark, sf_dir))


@register("match_rate", f"""
WITH {I.EMB_SQL}
SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE similarity_score >= {T})::BIGINT AS n_matched,
       round(avg(CASE WHEN similarity_score >= {T} THEN 1.0 ELSE 0.0 END), 6) AS match_share FROM best""")
def q_match_rate(spark, sf_dir):
    r = M.match_rate(best_matches(spark, sf_dir), T)
    return r.select("n_rows", "n_matched", r6("match_share").alias("match_share"))


@register("match_all_similarities", f"""
WITH {I.EMB_SQL}
SELECT doc_id, count(*)::BIGINT AS n_similarities, round(sum(s), 9) AS sum_similarity,
       round(min(s), 9) AS min_similarity, round(max(s), 9) AS max_similarity
FROM sim WHERE doc_id % 100 = 0 GROUP BY doc_id""")
def q_match_all_similarities(spark, sf_dir):
    """Every similarity of a stated query set (ids divisible by 100): one number
    per query and reference, not per corpus row and reference."""
    queries = I.embedding_corpus(spark, sf_dir).where("doc_id % 100 = 0")
    m = M.match(queries, I.embedding_reference(spark, sf_dir), keep_all=True)
    a = F.col("all_similarities")
    return m.select("doc_id", F.size(a).cast("bigint").alias("n_similarities"),
                    r9(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)).alias("sum_similarity"),
                    r9(F.array_min(a)).alias("min_similarity"),
                    r9(F.array_max(a)).alias("max_similarity"))


@register("classify_corpus", f"""
WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class, matched_node, round(similarity_score, 9) AS similarity_score FROM pred""")
def q_classify_corpus(spark, sf_dir):
    return thresholded(spark, sf_dir).select(
        "doc_id", "true_label", "predicted_class", "matched_node", r9("similarity_score").alias("similarity_score"))


@register("out_of_domain", f"""
WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, round(similarity_score, 9) AS similarity_score FROM pred WHERE predicted_class = 'Other'""")
def q_out_of_domain(spark, sf_dir):
    return (thresholded(spark, sf_dir).where(F.col("predicted_class") == M.OTHER)
            .select("doc_id", "true_label", r9("similarity_score").alias("similarity_score")))


@register("avg_similarity_by_class", f"""
WITH {I.EMB_SQL}, {PRED_SQL}
SELECT predicted_class AS class, round(avg(similarity_score), 6) AS avg_similarity, count(*)::BIGINT AS n
FROM pred GROUP BY 1""")
def q_avg_similarity_by_class(spark, sf_dir):
    r = M.avg_similarity_by_class(thresholded(spark, sf_dir))
    return r.select("class", r6("avg_similarity").alias("avg_similarity"), "n")
