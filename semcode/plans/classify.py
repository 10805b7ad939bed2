"""End-to-end jobs: prepare references, classify a corpus, evaluate, tune.

Each is a composition of the operators; the only driver round trips are the
reference-set size check (inside ``match``) and, in ``tune_and_classify``, the
one-row optimum.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.operators import bootstrap as B
from semcode.operators import encode as EN
from semcode.operators import evaluate as E
from semcode.operators import labels as L
from semcode.operators import match as M
from semcode.operators import prep as P
from semcode.operators import threshold as TH
from semcode.operators import vector_store as VS
from semcode.operators.partitioning import spread
from semcode.session import checkpoint_dir
from semcode.sources import sinks as SK
from semcode.sources import tables as ST


def prepare_reference(reference: DataFrame, key: str = "ref_id", class_col: str = "class",
                      node_col: str = "node", dim: int = EN.DEFAULT_DIM, encoder=None,
                      store: str | None = None, model: str | None = None) -> DataFrame:
    """``ref_id, class, node, embedding`` — the coded examples, encoded.
    ``encoder`` is an ``encoder_factory`` for ``encode_with``; default: hashed.
    ``store`` is a folder that keeps the vectors of ``model`` for later runs."""
    ref = reference.select(F.col(key).alias("ref_id"), F.col(class_col).cast("string").alias("class"),
                           F.col(node_col).cast("string").alias("node"))
    return _encoded(ref, "node", dim, encoder, store, model)


def _encoded(df: DataFrame, text_col: str, dim: int, encoder, store: str | None, model: str | None) -> DataFrame:
    if store is not None:
        if encoder is not None and model is None:
            raise ValueError("A stored encoder needs a model name.")
        return VS.encode_stored(df, text_col, store, model or f"hashed-{dim}", encoder or (lambda: EN.hashing_encoder(dim))).rows
    if encoder is None:
        return EN.hashed_encode(df, text_col, dim=dim)
    return EN.encode_with(df, text_col, encoder)


def encode_corpus(corpus: DataFrame, text_col: str = "text", dim: int = EN.DEFAULT_DIM,
                  encoder=None, null_policy: str = "empty", key: str | None = "doc_id",
                  store: str | None = None, model: str | None = None) -> DataFrame:
    """``null_policy``: ``"empty"`` encodes null text as "" (library rule),
    ``"drop"`` drops those rows (add-on rule)."""
    corpus = spread(corpus, key if key in corpus.columns else None)
    if null_policy == "drop":
        corpus = P.drop_missing(corpus, [text_col])
    elif null_policy != "empty":
        raise ValueError(f"Unknown null policy: {null_policy}")
    return _encoded(corpus, text_col, dim, encoder, store, model)


def classify(corpus: DataFrame, reference: DataFrame, threshold: float, *, key: str = "doc_id",
             text_col: str = "text", dim: int = EN.DEFAULT_DIM, encoder=None,
             null_policy: str = "empty", keep_embedding: bool = False,
             store: str | None = None, model: str | None = None) -> DataFrame:
    """Corpus columns + ``best_ref_id, best_class, best_node, similarity_score,
    predicted_class, matched_node``.  With a ``store``, texts that an earlier run
    (tuning, say) encoded are read from it."""
    M.check_threshold(threshold)
    ref = prepare_reference(reference, dim=dim, encoder=encoder, store=store, model=model)
    enc = encode_corpus(corpus, text_col, dim, encoder, null_policy, key, store, model)
    out = M.apply_threshold(M.match(enc, ref, key=key), threshold)
    return out if keep_embedding else out.drop("embedding")


def classify_rounded(corpus: DataFrame, reference: DataFrame, threshold: float, *,
                     key: str = "doc_id", text_col: str = "text", dim: int = EN.DEFAULT_DIM,
                     encoder=None) -> DataFrame:
    """Add-on variant: null texts dropped, ``Predicted Tag``, ``Cosine
    Similarity Score`` (4 decimals, rounded after the threshold test) and
    ``Matched Reference Sentence``."""
    out = classify(corpus, reference, threshold, key=key, text_col=text_col, dim=dim,
                   encoder=encoder, null_policy="drop")
    return (out.withColumn("Predicted Tag", F.col("predicted_class"))
            .withColumn("Cosine Similarity Score", F.round("similarity_score", 4))
            .withColumn("Matched Reference Sentence", F.col("matched_node"))
            .drop("best_ref_id", "best_class", "best_node", "similarity_score", "predicted_class",
                  "matched_node"))


def classify_summary(pred: DataFrame, class_col: str = "predicted_class") -> DataFrame:
    """One row: total rows, rows given a class, rows left as "Other", rows
    without a prediction (no vector)."""
    other = F.col(class_col) == F.lit(M.OTHER)
    return pred.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~other).alias("n_classified"),
                    F.count_if(other).alias("n_other"), F.count_if(F.col(class_col).isNull()).alias("n_failed"))


def classify_files(spark, corpus_path: str, reference_path: str, threshold: float, output_path: str, *,
                   text_col: str = "sentence", fmt: str = "csv", key: str = "doc_id", corpus_fmt: str | None = None,
                   compression: str | None = None, **kw) -> DataFrame:
    """Load a corpus and a reference from files, classify, save (``compression`` as in
    ``save_results``), and return the saved rows.  The corpus gets a running ``key`` if
    it has none."""
    corpus = ST.load_corpus(spark, corpus_path, text_col, fmt=corpus_fmt)
    if key not in corpus.columns:
        corpus = corpus.withColumn(key, F.monotonically_increasing_id())
    pred = classify(corpus, load_reference(spark, reference_path), threshold, key=key, text_col=text_col, **kw)
    SK.save_results(pred, output_path, fmt=fmt, compression=compression)
    return SK.read_results(spark, output_path, pred.schema, fmt=fmt)


def load_reference(spark, path: str) -> DataFrame:
    """``ref_id, class, node`` from a reference file (``class``, ``matching_node``
    and, if it has one, ``ref_id``; else rows are numbered)."""
    ref = ST.load_reference(spark, path)
    number = F.col("ref_id").cast("long") if "ref_id" in ref.columns else F.monotonically_increasing_id()
    return ref.select(number.alias("ref_id"), "class", F.col("matching_node").alias("node"))


class Evaluation(NamedTuple):
    summary: DataFrame
    per_class: DataFrame
    confusion: DataFrame
    counts: DataFrame          # n_unmatched, n_failed, n_unknown_labels (one row)
    replicates: DataFrame | None
    intervals: DataFrame | None


class Tuning(NamedTuple):
    optimum: dict
    curve: DataFrame
    distribution: DataFrame
    intervals: DataFrame | None            # per threshold
    optimum_intervals: DataFrame | None    # at the optimum
    predictions: DataFrame
    summary: DataFrame


def evaluate_classification(pred: DataFrame, truth: DataFrame, key: str = "doc_id",
                            true_col: str = "label", classes=None):
    """Join predictions to true labels by key and score them:
    (summary, per_class, confusion)."""
    scored = pred.join(truth.select(key, F.col(true_col).alias("true_label")), key)
    return E.evaluate(scored, "true_label", "predicted_class", classes)


def evaluation_report(pred: DataFrame, truth: DataFrame, key: str = "doc_id", true_col: str = "label", classes=None, *,
                      reference: DataFrame | None = None, n_bootstrap: int = 1000, levels=(0.9, 0.95, 0.99),
                      seed: int = 0) -> Evaluation:
    """The whole evaluation: labelled rows without a prediction row
    (``n_unmatched``) or with a null one (``n_failed``), labels that are no
    reference class, metrics, and bootstrap intervals (``n_bootstrap=0``: none).

    The joined rows are checkpointed; every part reads them."""
    checkpoint_dir(pred.sparkSession)
    rows = truth.where(F.col(true_col).isNotNull()).select(key, F.col(true_col).cast("string").alias("true_label")).join(
        pred.select(key, "predicted_class", F.lit(True).alias("_found")), key, "left").checkpoint(eager=True)
    counts = rows.agg(F.count_if(F.col("_found").isNull()).alias("n_unmatched"),
                      F.count_if(F.col("_found") & F.col("predicted_class").isNull()).alias("n_failed"))
    if reference is not None:
        unknown = L.unknown_labels(rows, reference, "true_label", "class").agg(F.count(F.lit(1)).alias("n_unknown_labels"))
        counts = (counts.withColumn("_g", F.lit(0)).join(unknown.withColumn("_g", F.lit(0)), "_g").drop("_g"))
    summary, per, conf = E.evaluate(rows, "true_label", "predicted_class", classes)
    reps = iv = None
    if n_bootstrap:
        reps, iv = B.bootstrap(rows, n_iterations=n_bootstrap, levels=levels, seed=seed)
    return Evaluation(summary, per, conf, counts, reps, iv)


def tune_and_classify(matches: DataFrame, start: float, end: float, step: float, metric: str = "f1_macro",
                      true_col: str = "true_label", n_bootstrap: int = 0, level: float = 0.95, seed: int = 0) -> Tuning:
    """Sweep thresholds on matched, labelled rows, pick the first best one and
    classify the same rows with it; with ``n_bootstrap``, intervals for every
    threshold and at the optimum from the same draws.

    The match table is checkpointed to the shared checkpoint folder: it feeds
    the sweep and the final labelling, and its lineage holds the encode + GEMM
    work.  Everything else runs on the sweep's cells.
    """
    checkpoint_dir(matches.sparkSession)
    matches = matches.checkpoint(eager=True)
    curve, dist = TH.sweep(matches, start, end, step, true_col=true_col)
    best = TH.optimum(curve, metric).first().asDict()
    pred = M.apply_threshold(matches, best["threshold"])
    summary = E.summary(E.confusion(pred, true_col, "predicted_class"))
    iv = at = None
    if n_bootstrap:
        cells = TH.sweep_cells(matches, TH.threshold_grid(start, end, step), true_col=true_col).checkpoint(eager=True)
        ask = dict(n_iterations=n_bootstrap, level=level, seed=seed, cells=cells)
        iv = TH.sweep_intervals(matches, start, end, step, **ask)
        at = TH.sweep_intervals(matches, start, end, step, at=int(best["threshold_idx"]), **ask)
    return Tuning(best, curve, dist, iv, at, pred, summary)
