"""Keyed inputs built from the driver's Parquet tables.

``embeddings``: a seeded hash splits the rows into two roles — about 10 % are
coded reference examples (class = ``label``), the rest is the corpus to code
(true class = ``label``).  Every row takes part in every query.

``documents``: labelled documents carry a class derived from ``labels``
(``toxic`` / ``good`` / ``poor``); the same hash split picks about 10 % of
them as reference examples, the rest of the documents is the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcode.functions.hashing import md5_u32_sql, uniform01

SEED = 42
REFERENCE_SHARE = 0.1
THRESHOLD = 0.30
GRID = (0.20, 0.40, 0.01)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_reference(key: str) -> F.Column:
    return uniform01(SEED, F.lit("ref"), F.col(key)) < F.lit(REFERENCE_SHARE)


def is_reference_sql(key: str) -> str:
    inner = f"'{SEED}:ref:' || CAST({key} AS VARCHAR)"
    return f"({md5_u32_sql(inner, 'duckdb')}) / 4294967296.0 < {REFERENCE_SHARE}"


def embedding_reference(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(is_reference("vec_id")).select(
        F.col("vec_id").alias("ref_id"), F.col("label").cast("string").alias("class"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("node"), "embedding")


def embedding_corpus(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(~is_reference("vec_id")).select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("true_label"), "embedding")


# DuckDB twins of the two inputs above, plus the best-match table.
EMB_SQL = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
             {is_reference_sql('vec_id')} AS is_ref FROM embeddings),
ref AS (SELECT vec_id AS ref_id, CAST(label AS VARCHAR) AS class, 'vec ' || CAST(vec_id AS VARCHAR) AS node,
               v, sqrt(list_dot_product(v, v)) AS rn FROM e WHERE is_ref),
cor AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS true_label,
               v, sqrt(list_dot_product(v, v)) AS qn FROM e WHERE NOT is_ref),
sim AS (SELECT cor.doc_id, cor.true_label, ref.ref_id, ref.class, ref.node,
               CASE WHEN qn = 0 OR rn = 0 THEN 0.0
                    ELSE round(list_dot_product(cor.v, ref.v) / (qn * rn), 9) END AS s
        FROM cor CROSS JOIN ref),
best AS (SELECT doc_id, true_label, ref_id AS best_ref_id, class AS best_class, node AS best_node,
                s AS similarity_score
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ref_id) AS rk FROM sim)
         WHERE rk = 1)"""


def doc_class_expr() -> F.Column:
    return (F.when(F.col("toxic") == 1, F.lit("toxic"))
            .when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("poor")))


DOC_CLASS_SQL = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END"


def labelled(spark, sf_dir) -> DataFrame:
    """``labels`` with a class and the reference role (no text needed)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", "quality", "toxic", doc_class_expr().alias("class"),
                      is_reference("doc_id").alias("is_ref"))


def doc_reference(spark, sf_dir) -> DataFrame:
    """Coded examples: ``ref_id, class, node`` (node = the document text)."""
    ref = labelled(spark, sf_dir).where("is_ref").select("doc_id", "class")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ref.join(docs, "doc_id").select(F.col("doc_id").alias("ref_id"), "class",
                                           F.col("text").alias("node"))


def doc_labelled(spark, sf_dir) -> DataFrame:
    """Labelled documents kept for evaluation: ``doc_id, label``."""
    return labelled(spark, sf_dir).where(~F.col("is_ref")).select("doc_id", F.col("class").alias("label"))


DOC_SQL = f"""
lab AS (SELECT doc_id, quality, toxic, {DOC_CLASS_SQL} AS class, {is_reference_sql('doc_id')} AS is_ref FROM labels),
dref AS (SELECT l.doc_id AS ref_id, l.class, d.text AS node FROM lab l JOIN documents d USING (doc_id) WHERE l.is_ref),
dlab AS (SELECT doc_id, class AS label FROM lab WHERE NOT is_ref)"""


def file_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Names, lengths and times of a table's files: a fit is reused while these stay."""
    hadoop, out = spark._jsc.hadoopConfiguration(), []
    for f in table(spark, sf_dir, name).inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(hadoop).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return (spark.sparkContext.applicationId, *sorted(out))
