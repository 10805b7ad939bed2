"""Queries: encoding jobs and end-to-end classification of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcode.functions.vectors import l2_normalize, norm
from semcode.operators import bootstrap as B
from semcode.operators import encode as EN
from semcode.operators import evaluate as E
from semcode.operators import match as M
from semcode.operators import threshold as TH
from semcode.operators import vector_store as VS
from semcode.operators.partitioning import spread
from semcode.plans import classify as C
from semcode.plans import inputs as I
from semcode.plans import sqlgen as S
from semcode.plans.registry import register, r6, r9
from semcode.session import scratch_path
from semcode.sources import sinks as SK

DIM = EN.DEFAULT_DIM
DOC_T = 0.90
DOC_GRID = (0.80, 0.98, 0.01)

_SPLIT = r"'[^\p{L}\p{N}]+'"


def _tok_sql(src: str, key: str, text: str) -> str:
    return (f"(SELECT {key}, unnest(list_filter(string_split_regex(lower(coalesce({text}, '')), {_SPLIT}), "
            f"lambda t: length(t) > 0)) AS tok FROM {src})")


def _vec_sql(name: str, src: str, key: str, text: str) -> str:
    """CTEs ``{name}_c`` (key, bucket, c) and ``{name}`` (key, bucket, value)."""
    return f"""{name}_c AS (SELECT {key}, CAST({S.md5_u32('tok')} % {DIM} AS INTEGER) AS bucket, count(*) AS c
    FROM {_tok_sql(src, key, text)} GROUP BY ALL),
{name} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS value FROM {name}_c)"""


def _long(df, key, col="embedding", extra=()):
    """Vector column to long ``(key, extra..., bucket, value)``, non-zero entries."""
    return (df.select(key, *extra, F.posexplode(col).alias("bucket", "value"))
            .where(F.col("value") != 0)
            .select(key, *extra, F.col("bucket").cast("int").alias("bucket"), r6("value").alias("value")))


# ---------------------------------------------------------------- encoding
@register("embed_corpus", f"""WITH {_vec_sql('v', 'documents', 'doc_id', 'text')}
SELECT doc_id, bucket, round(value, 6) AS value FROM v""")
def q_embed_corpus(spark, sf_dir):
    """The encoder host over all documents, each distinct text encoded once."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _long(EN.encode_with(docs, "text", lambda: EN.hashing_encoder(DIM), dedupe=True), "doc_id")


@register("embed_corpus_sql", f"""WITH {_vec_sql('v', 'documents', 'doc_id', 'text')}
SELECT doc_id, bucket, round(value, 6) AS value FROM v""")
def q_embed_corpus_sql(spark, sf_dir):
    """Same encoder as a pure Spark SQL plan (explode + aggregate): cross-plan check."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = EN.hashed_counts_long(docs, "doc_id", "text", DIM)
    return out.select("doc_id", F.col("bucket").cast("int").alias("bucket"), r6("value").alias("value"))


def _store_runs(spark, sf_dir):
    """(labelled documents, then all documents, then all again) through one store."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(I.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    path = scratch_path(spark, "vectors")
    return [VS.encode_stored(d, "text", path, f"hashed-{DIM}", lambda: EN.hashing_encoder(DIM)) for d in (labelled, docs, docs)]


@register("embed_stored", f"""WITH {_vec_sql('v', 'documents', 'doc_id', 'text')}
SELECT doc_id, bucket, round(value, 6) AS value FROM v""")
def q_embed_stored(spark, sf_dir):
    """All documents from a store that earlier runs filled."""
    return _long(_store_runs(spark, sf_dir)[-1].rows, "doc_id")


@register("embed_store_runs", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT count(DISTINCT t) AS every, (SELECT count(DISTINCT t) FROM d SEMI JOIN labels USING (doc_id)) AS lab,
             (SELECT count(*) FROM d SEMI JOIN labels USING (doc_id)) AS rows1, count(*) AS rows2 FROM d)
SELECT CAST(run AS INTEGER) AS run, CAST(CASE run WHEN 1 THEN rows1 ELSE rows2 END AS BIGINT) AS n_rows,
       CAST(CASE run WHEN 1 THEN lab WHEN 2 THEN every - lab ELSE 0 END AS BIGINT) AS n_encoded FROM range(1, 4) r(run), n""")
def q_embed_store_runs(spark, sf_dir):
    """Rows and newly encoded texts of each run: none in the last."""
    runs = _store_runs(spark, sf_dir)
    parts = [r.rows.where(F.col("embedding").isNotNull()).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(i).alias("run"), "n_rows", F.lit(r.n_encoded).cast("bigint").alias("n_encoded")) for i, r in enumerate(runs, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("embed_reference", f"""WITH {I.DOC_SQL}, {_vec_sql('v', 'dref', 'ref_id', 'node')}
SELECT v.ref_id, dref.class, v.bucket, round(v.value, 6) AS value FROM v JOIN dref USING (ref_id)""")
def q_embed_reference(spark, sf_dir):
    ref = C.prepare_reference(I.doc_reference(spark, sf_dir), dim=DIM)
    return _long(ref, "ref_id", extra=("class",))


@register("mean_pool", f"""WITH {_vec_sql('v', 'conversations', 'conv_id, turn', 'text')},
turns AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id),
uv AS (SELECT v.conv_id, v.bucket, sum(v.value) AS s FROM v JOIN conversations c USING (conv_id, turn)
       WHERE c.role = 'user' GROUP BY ALL)
SELECT uv.conv_id, uv.bucket, round(s / greatest(n_user, 1e-9), 6) AS value
FROM uv JOIN turns USING (conv_id) WHERE s != 0""")
def q_mean_pool(spark, sf_dir):
    """Conversation vector = mean of its user turns' vectors (mask = role)."""
    conv = I.table(spark, sf_dir, "conversations")
    turns = EN.hashed_encode(conv, "text", dim=DIM).withColumn(
        "mask", (F.col("role") == F.lit("user")).cast("int"))
    pooled = EN.mean_pool(turns, "conv_id", "turn", "embedding", "mask")
    return _long(pooled, "conv_id")


@register("l2_normalize", """SELECT vec_id,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) ** 2))), 6) AS norm_after,
  round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS sum_after
FROM embeddings""")
def q_l2_normalize(spark, sf_dir):
    e = I.table(spark, sf_dir, "embeddings").withColumn("u", l2_normalize("embedding"))
    return e.select("vec_id", r6(norm("u")).alias("norm_after"),
                    r6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("sum_after"))


@register("embed_request_plan", f"""WITH {I.DOC_SQL}
SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_corpus, CAST((SELECT count(*) FROM dref) AS BIGINT) AS n_reference,
       CAST(floor((SELECT count(*) FROM documents) / 100) + 1 + floor((SELECT count(*) FROM dref) / 100) + 1 AS BIGINT) AS n_requests""")
def q_request_plan(spark, sf_dir):
    n_c = I.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_corpus"))
    n_r = I.doc_reference(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_reference"))
    both = n_c.withColumn("_g", F.lit(0)).join(n_r.withColumn("_g", F.lit(0)), "_g").drop("_g")
    return both.withColumn("n_requests", EN.request_plan(F.col("n_corpus")) + EN.request_plan(F.col("n_reference")))


# ------------------------------------------------- documents, end to end
DOC_MATCH_SQL = f"""{I.DOC_SQL},
{_vec_sql('dv', 'documents', 'doc_id', 'text')},
{_vec_sql('rv', 'dref', 'ref_id', 'node')},
dn AS (SELECT doc_id, sqrt(sum(value * value)) AS qn FROM dv GROUP BY doc_id),
rn AS (SELECT ref_id, sqrt(sum(value * value)) AS rn FROM rv GROUP BY ref_id),
dots AS (SELECT dv.doc_id, rv.ref_id, sum(dv.value * rv.value) AS dot FROM dv JOIN rv USING (bucket) GROUP BY ALL),
dsim AS (SELECT d.doc_id, r.ref_id, r.class, r.node,
                CASE WHEN coalesce(dn.qn, 0) = 0 OR coalesce(rn.rn, 0) = 0 THEN 0.0
                     ELSE round(coalesce(dots.dot, 0) / (dn.qn * rn.rn), 9) END AS s
         FROM documents d CROSS JOIN dref r LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN rn ON rn.ref_id = r.ref_id
         LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.ref_id = r.ref_id),
dbest AS (SELECT doc_id, ref_id AS best_ref_id, class AS best_class, node AS best_node, s AS similarity_score
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ref_id) AS rk FROM dsim) WHERE rk = 1),
dpred AS (SELECT *, CASE WHEN similarity_score >= {DOC_T} THEN best_class ELSE 'Other' END AS predicted_class,
                    CASE WHEN similarity_score >= {DOC_T} THEN best_node ELSE '' END AS matched_node FROM dbest)"""


def doc_predictions(spark, sf_dir, t=DOC_T):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.classify(docs, I.doc_reference(spark, sf_dir), t)


@register("classify_documents", f"""WITH {DOC_MATCH_SQL}
SELECT doc_id, best_ref_id, predicted_class, round(similarity_score, 9) AS similarity_score FROM dpred""")
def q_classify_documents(spark, sf_dir):
    return doc_predictions(spark, sf_dir).select("doc_id", "best_ref_id", "predicted_class",
                                                 r9("similarity_score").alias("similarity_score"))


@register("classify", f"""WITH {DOC_MATCH_SQL}
SELECT doc_id, predicted_class, md5(matched_node) AS matched_node_md5, round(similarity_score, 9) AS similarity_score
FROM dpred""")
def q_classify(spark, sf_dir):
    """End to end from files: load corpus (CSV) and reference, encode, match,
    threshold, write the result (CSV) and read it back."""
    base = scratch_path(spark, "classify")
    SK.save_results(I.table(spark, sf_dir, "documents").select("doc_id", "text"), base + "/corpus", fmt="csv", compression="zstd")
    ref = I.doc_reference(spark, sf_dir).select("class", F.col("node").alias("matching_node"), "ref_id")
    SK.save_results(ref, base + "/reference")
    back = C.classify_files(spark, base + "/corpus", base + "/reference", DOC_T, base + "/out", text_col="text",
                            corpus_fmt="csv", fmt="csv", compression="zstd")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "predicted_class", F.md5("matched_node").alias("matched_node_md5"),
                       r9("similarity_score").alias("similarity_score"))


@register("classify_rounded", f"""WITH {DOC_MATCH_SQL}
SELECT doc_id, lang, predicted_class AS "Predicted Tag", round(similarity_score, 4) AS "Cosine Similarity Score",
       md5(matched_node) AS "Matched Reference Sentence md5"
FROM dpred JOIN documents USING (doc_id)""")
def q_classify_rounded(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = C.classify_rounded(docs, I.doc_reference(spark, sf_dir), DOC_T)
    return out.select("doc_id", "lang", "Predicted Tag", "Cosine Similarity Score",
                      F.md5("Matched Reference Sentence").alias("Matched Reference Sentence md5"))


@register("classify_summary", f"""WITH {DOC_MATCH_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (WHERE predicted_class != 'Other') AS BIGINT) AS n_classified,
       CAST(count(*) FILTER (WHERE predicted_class = 'Other') AS BIGINT) AS n_other,
       CAST(count(*) FILTER (WHERE predicted_class IS NULL) AS BIGINT) AS n_failed FROM dpred""")
def q_classify_summary(spark, sf_dir):
    return C.classify_summary(doc_predictions(spark, sf_dir))


@register("prepare_reference", f"""WITH {I.DOC_SQL}, {_vec_sql('rv', 'dref', 'ref_id', 'node')}
SELECT ref_id, class, md5(node) AS node_md5, CAST(count(*) AS BIGINT) AS n_buckets,
       round(sum(value), 6) AS sum_value FROM rv JOIN dref USING (ref_id) GROUP BY ref_id, class, node""")
def q_prepare_reference(spark, sf_dir):
    ref = C.prepare_reference(I.doc_reference(spark, sf_dir), dim=DIM)
    v = F.col("embedding")
    return ref.select("ref_id", "class", F.md5("node").alias("node_md5"),
                      F.size(F.filter(v, lambda x: x != 0)).cast("bigint").alias("n_buckets"),
                      r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("sum_value"))


EVAL_DOC_SQL = f"""{DOC_MATCH_SQL},
dcells AS (SELECT l.label AS true_class, p.predicted_class, CAST(count(*) AS BIGINT) AS n
           FROM dpred p JOIN dlab l USING (doc_id) GROUP BY ALL),
{S.metric_ctes('dcells', [], 'e')}"""


@register("evaluate_classification", f"""WITH {EVAL_DOC_SQL}
SELECT round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro,
       round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro, n_samples,
       CAST((SELECT count(*) FROM dlab) - n_samples AS BIGINT) AS n_unmatched, CAST(0 AS BIGINT) AS n_failed,
       CAST((SELECT count(*) FROM (SELECT DISTINCT label FROM dlab WHERE label NOT IN (SELECT class FROM dref))) AS BIGINT)
         AS n_unknown_labels,
       CAST(1000 AS BIGINT) AS n_replicates, TRUE AS bounds_nested FROM e_sum""")
def q_evaluate_classification(spark, sf_dir):
    """The whole job: validate labels, score, 1,000 bootstrap replicates."""
    r = C.evaluation_report(doc_predictions(spark, sf_dir), I.doc_labelled(spark, sf_dir),
                            reference=I.doc_reference(spark, sf_dir), n_bootstrap=1000, seed=42)
    n = r.replicates.agg(F.count_distinct("iteration").alias("n_replicates"))
    one = lambda df: df.withColumn("_g", F.lit(0))  # noqa: E731 - one-row tables side by side
    out = one(r.summary)
    for df in (r.counts, n, B.bounds_nested(r.intervals).agg(F.min("bounds_nested").alias("bounds_nested"))):
        out = out.join(one(df), "_g")
    return out.select(*[r6(c).alias(c) for c in E.METRICS], "n_samples", "n_unmatched", "n_failed", "n_unknown_labels",
                      "n_replicates", "bounds_nested")


@register("evaluate_per_class_documents", f"""WITH {EVAL_DOC_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM e_pc""")
def q_evaluate_per_class_documents(spark, sf_dir):
    _, per, _ = C.evaluate_classification(doc_predictions(spark, sf_dir), I.doc_labelled(spark, sf_dir))
    return per.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_DG = TH.threshold_grid(*DOC_GRID)
_DG_SQL = " UNION ALL ".join(f"SELECT {i} AS threshold_idx, CAST({t!r} AS DOUBLE) AS threshold" for i, t in enumerate(_DG))
_DPTS = "[" + ", ".join(repr(float(t)) for t in _DG) + "]"


@register("tune_and_classify", f"""WITH {EVAL_DOC_SQL},
grid AS ({_DG_SQL}),
bk AS (SELECT l.label AS true_class, b.best_class,
              CAST(len(list_filter({_DPTS}, lambda t: t <= b.similarity_score)) AS INTEGER) AS bucket
       FROM dbest b JOIN dlab l USING (doc_id)),
tc AS (SELECT g.threshold_idx, bk.true_class,
              CASE WHEN bk.bucket > g.threshold_idx THEN bk.best_class ELSE 'Other' END AS predicted_class,
              CAST(count(*) AS BIGINT) AS n FROM bk JOIN grid g ON true GROUP BY ALL),
{S.metric_ctes('tc', ['threshold_idx'], 't')},
opt AS (SELECT s.*, g.threshold FROM t_sum s JOIN grid g USING (threshold_idx)
        ORDER BY round(f1_macro, 9) DESC, threshold_idx LIMIT 1)
SELECT round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro,
       round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro, n_samples,
       CAST({len(_DG)} AS BIGINT) AS n_thresholds, CAST({4 * len(_DG)} AS BIGINT) AS n_intervals,
       CAST(4 AS BIGINT) AS n_optimum_intervals, TRUE AS bounds_ordered FROM opt""")
def q_tune_and_classify(spark, sf_dir):
    """Sweep with intervals, the optimum with its own, and the final labelling."""
    docs = spread(I.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    ref = C.prepare_reference(I.doc_reference(spark, sf_dir), dim=DIM)
    labelled = C.encode_corpus(docs.join(I.doc_labelled(spark, sf_dir), "doc_id"), "text").drop("text")
    matches = M.match(labelled, ref).withColumnRenamed("label", "true_label")
    r = C.tune_and_classify(matches, *DOC_GRID, metric="f1_macro", n_bootstrap=100, seed=42)
    ordered = lambda df, n: df.agg(F.count(F.lit(1)).alias(n), F.min(F.col("lower") <= F.col("upper")).alias(f"{n}_ok"))
    one = lambda df: df.withColumn("_g", F.lit(0))
    out = (one(r.summary).join(one(ordered(r.intervals, "n_intervals")), "_g")
           .join(one(ordered(r.optimum_intervals, "n_optimum_intervals")), "_g")
           .join(one(r.curve.agg(F.count(F.lit(1)).alias("n_thresholds"))), "_g"))
    return out.select(F.lit(round(r.optimum["threshold"], 6)).alias("threshold"), *[r6(c).alias(c) for c in E.METRICS], "n_samples",
                      "n_thresholds", "n_intervals", "n_optimum_intervals",
                      (F.col("n_intervals_ok") & F.col("n_optimum_intervals_ok")).alias("bounds_ordered"))
