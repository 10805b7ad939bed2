"""A training-data pipeline over ``documents``: five stages, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``documents`` (the last one returns tokens).  Each works on all rows its
predecessor kept.  Rows sharing an id are judged together where a stage decides
by id (near duplicates) and row by row elsewhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcode.llm import bpe, line_dedup, mixing, ngram_join, quality_classifier
from semcode.llm.shared import discard, materialize, table

#: word shingles and similarity of the near-duplicate stage
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents the classifier scores at its threshold or above."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    weights = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    return docs.where(quality_classifier.score(docs, weights) >= quality_classifier.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document with a smaller id holds; ``n_chars`` follows."""
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = ngram_join.ngram_components(docs, k=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])
    return ngram_join.keep_one(docs, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop, keep or repeat documents so that sources meet their target words."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digest of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                          keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: the classifier has no SQL form; tests/llm holds the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written once and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
