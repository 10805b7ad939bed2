"""Queries: scans, preparation and label validation on documents / labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcode.operators import labels as L
from semcode.operators import prep as P
from semcode.plans import inputs as I
from semcode.plans.registry import register, r6
from semcode.session import scratch_path
from semcode.sources import sinks as SK
from semcode.sources import tables as ST


def docs(spark, sf_dir):
    return I.table(spark, sf_dir, "documents")


@register("load_corpus", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT) AS nulls_text FROM documents")
def q_load_corpus(spark, sf_dir):
    """All documents through CSV and the loader."""
    path = scratch_path(spark, "corpus")
    SK.save_results(docs(spark, sf_dir).select("doc_id", "text"), path, fmt="csv")
    return ST.null_report(ST.load_corpus(spark, path, "text", fmt="csv", null_values=()), ["text"])


@register("null_report", """SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT) AS nulls_text,
  CAST(count(*) FILTER (WHERE lang IS NULL) AS BIGINT) AS nulls_lang,
  CAST(count(*) FILTER (WHERE source IS NULL) AS BIGINT) AS nulls_source FROM documents""")
def q_null_report(spark, sf_dir):
    return ST.null_report(docs(spark, sf_dir), ["text", "lang", "source"])


def raw_reference(spark, sf_dir):
    """The coded examples as a coder hands them in: ``tag, sentence``."""
    return I.doc_reference(spark, sf_dir).select("ref_id", F.col("class").alias("tag"),
                                                 F.col("node").alias("sentence"))


@register("rename_reference", f"WITH {I.DOC_SQL} SELECT ref_id, class, node AS matching_node FROM dref")
def q_rename_reference(spark, sf_dir):
    return P.rename_reference(raw_reference(spark, sf_dir))


@register("load_reference", f"""WITH {I.DOC_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT class) AS BIGINT) AS n_classes,
       count(*) FILTER (WHERE class IS NULL OR node IS NULL) > 0 AS has_nulls FROM dref""")
def q_load_reference(spark, sf_dir):
    path = scratch_path(spark, "reference")
    SK.save_results(P.rename_reference(raw_reference(spark, sf_dir)), path, fmt="csv")
    ref = ST.load_reference(spark, path, fmt="csv", null_values=())
    return ST.reference_summary(ref, "class", "matching_node")


@register("load_labeled", f"""WITH {I.DOC_SQL}
SELECT class AS label, CAST(count(*) AS BIGINT) AS n,
       CAST((SELECT count(*) FROM lab WHERE class IS NULL) AS BIGINT) AS n_null_labels FROM lab GROUP BY class""")
def q_load_labeled(spark, sf_dir):
    path = scratch_path(spark, "labeled")
    SK.save_results(all_labels(spark, sf_dir), path, fmt="csv")
    lab = ST.load_labeled(spark, path, fmt="csv")
    nulls = ST.null_report(lab, ["label"]).select(F.col("nulls_label").alias("n_null_labels"), F.lit(0).alias("_g"))
    return ST.label_distribution(lab, "label").withColumn("_g", F.lit(0)).join(nulls, "_g").drop("_g")


def all_labels(spark, sf_dir):
    """Every row of ``labels``: ``doc_id, label``."""
    return I.labelled(spark, sf_dir).select("doc_id", F.col("class").alias("label"))


def raw_labels(spark, sf_dir):
    """Coder sheet as handed in: string ``Label`` with '0' for "no code"."""
    lab = I.labelled(spark, sf_dir)
    return lab.select("doc_id", F.col("quality").cast("string").alias("Label"))


RAW_LABELS_SQL = f"""{I.DOC_SQL},
plab AS (SELECT doc_id, CASE WHEN CAST(quality AS VARCHAR) = '0' THEN 'Other' ELSE CAST(quality AS VARCHAR) END AS label
         FROM lab)"""


@register("prepare_labels", f"WITH {RAW_LABELS_SQL} SELECT doc_id, label FROM plab")
def q_prepare_labels(spark, sf_dir):
    return P.prepare_labels(raw_labels(spark, sf_dir))


@register("prepare_labels_report", f"""WITH {RAW_LABELS_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE label = 'Other') AS BIGINT) AS n_other FROM plab""")
def q_prepare_labels_report(spark, sf_dir):
    return P.other_count(P.prepare_labels(raw_labels(spark, sf_dir)))


@register("fill_empty_text", """SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS text_length,
       md5(coalesce(text, '')) AS text_md5 FROM documents""")
def q_fill_empty_text(spark, sf_dir):
    df = P.fill_empty_text(docs(spark, sf_dir), "text")
    return df.select("doc_id", F.length("text").alias("text_length"), F.md5("text").alias("text_md5"))


@register("drop_missing", "SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def q_drop_missing(spark, sf_dir):
    return P.drop_missing(docs(spark, sf_dir), ["text", "lang"]).select("doc_id", "lang", "source")


@register("cast_text", """SELECT conv_id, turn, CAST(turn AS VARCHAR) AS turn_text, md5(CAST(text AS VARCHAR)) AS text_md5
FROM conversations""")
def q_cast_text(spark, sf_dir):
    c = P.cast_text(P.cast_text(I.table(spark, sf_dir, "conversations").withColumn("turn_text", F.col("turn")),
                                "turn_text"), "text")
    return c.select("conv_id", "turn", "turn_text", F.md5("text").alias("text_md5"))


@register("dataset_stats", f"""WITH {I.DOC_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT class) AS BIGINT) AS n_classes FROM lab""")
def q_dataset_stats(spark, sf_dir):
    return P.dataset_stats(all_labels(spark, sf_dir), "label")


@register("class_shares", f"""WITH {I.DOC_SQL}
SELECT class, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM lab GROUP BY class""")
def q_class_shares(spark, sf_dir):
    s = P.class_shares(all_labels(spark, sf_dir), "label")
    return s.select("class", "n", r6("share").alias("share"))


@register("preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(spark, sf_dir):
    return P.preview(docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), "doc_id", 5)


# ------------------------------------------------------------ label sets
def prepared_labels(spark, sf_dir):
    return P.prepare_labels(raw_labels(spark, sf_dir))


def doc_ref_classes(spark, sf_dir):
    return I.labelled(spark, sf_dir).where("is_ref").select(F.col("doc_id").alias("ref_id"), "class")


@register("validate_labels", f"""WITH {RAW_LABELS_SQL},
unk AS (SELECT DISTINCT label FROM plab WHERE label IS NOT NULL AND label NOT IN (SELECT class FROM lab WHERE is_ref AND class IS NOT NULL))
SELECT (SELECT count(*) FROM unk) = 0 AS is_valid, CAST((SELECT count(*) FROM unk) AS BIGINT) AS n_unknown,
       CAST((SELECT count(*) FROM plab WHERE label IS NULL) AS BIGINT) AS n_null_labels""")
def q_validate_labels(spark, sf_dir):
    return L.validate_labels(prepared_labels(spark, sf_dir), doc_ref_classes(spark, sf_dir))


@register("unknown_labels", f"""WITH {RAW_LABELS_SQL}
SELECT DISTINCT label FROM plab WHERE label IS NOT NULL AND label NOT IN (SELECT class FROM lab WHERE is_ref AND class IS NOT NULL)""")
def q_unknown_labels(spark, sf_dir):
    return L.unknown_labels(prepared_labels(spark, sf_dir), doc_ref_classes(spark, sf_dir))


@register("common_labels", f"""WITH {I.DOC_SQL},
rc AS (SELECT DISTINCT class FROM lab WHERE is_ref AND class IS NOT NULL),
lc AS (SELECT DISTINCT label AS class FROM dlab WHERE label IS NOT NULL)
SELECT CAST((SELECT count(*) FROM rc) AS BIGINT) AS n_reference, CAST((SELECT count(*) FROM lc) AS BIGINT) AS n_labeled,
       CAST((SELECT count(*) FROM (SELECT class FROM rc INTERSECT SELECT class FROM lc)) AS BIGINT) AS n_common""")
def q_common_labels(spark, sf_dir):
    return L.common_labels(I.doc_labelled(spark, sf_dir), doc_ref_classes(spark, sf_dir))


@register("distinct_classes", f"WITH {I.DOC_SQL} SELECT DISTINCT class FROM lab WHERE is_ref AND class IS NOT NULL")
def q_distinct_classes(spark, sf_dir):
    return L.distinct_classes(doc_ref_classes(spark, sf_dir))


@register("class_index", f"""WITH {I.DOC_SQL}
SELECT class, CAST(row_number() OVER (ORDER BY min(doc_id), class) - 1 AS INTEGER) AS class_idx
FROM lab WHERE is_ref GROUP BY class""")
def q_class_index(spark, sf_dir):
    return L.class_index(doc_ref_classes(spark, sf_dir))
