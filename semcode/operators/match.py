"""Nearest-reference matching: each text gets the class of its most
cosine-similar reference vector, or "Other" below a threshold.

One behaviour at every reference size.  Only (row number, vector) of a
reference takes part in the search; class and node are joined to the winner
afterwards, so texts never travel with the vectors.  That join is a broadcast
when class and node are within a checked size; else it is salted by the corpus
row, as one reference (or a missing vector) may win a third of the corpus.
Reference rows without a vector cannot be matched and are left out
(``reference_report`` counts them).

* **Broadcast plan** (reference matrix within a checked byte budget, or a
  streaming corpus): the matrix is broadcast in slices of at most
  ``block_bytes`` and a scalar Arrow UDF multiplies each batch with it, tile by
  tile.  Only the vector column crosses into Python; the search is one narrow
  stage over the corpus.
* **Tree plan** (above the budget): corpus rows get an internal number and are
  written once to the shared checkpoint folder.  References are clustered (centres
  from a coreset, broadcast) and packed into bins of at most ``block_bytes``, a large
  cluster over several.  A row first meets its nearest cluster; then only the clusters
  whose angle to it less their widest angle allows a score as good as the one found.
  One cogroup task per bin and chunk of rows, sizes from the counts; winners are
  reduced by the internal number, so repeated or missing keys do not mix.
* **Blocked plan** (``keep_all`` above the budget): references in R hash blocks meet
  the corpus in C chunks and the pairs return all similarities.

A stream cannot be cut into blocks: above the budget classify it batch by batch
(``streaming.classify_stream.classify_batches``), where each batch takes the
blocked plan; ``match`` itself broadcasts the reference to a stream at any size.

Ties go to the lowest ``ref_id`` (then the reference's own order) in both
plans; decisions use scores rounded to 9 decimals so that BLAS summation order
cannot flip them.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.functions.vectors import SCORE_DECIMALS, l2_normalize
from semcode.operators.cluster import CORESET_ROWS, coreset, coreset_fits
from semcode.session import checkpoint_dir

OTHER = "Other"
DEFAULT_BROADCAST_BYTES = 256 << 20   # reference matrix budget (doubles)
DEFAULT_BLOCK_BYTES = 64 << 20        # one GEMM slice: rows x M x 8 bytes
TILE_BYTES = 8 << 20                  # similarities that are computed at once
PAIR_BLOCK_BYTES = 1 << 20            # rows and references of a task that returns pairs
MAX_NAME_BYTES = 64 << 20             # class and node of the reference, to be broadcast
SALTS = 4                             # parts of a winner's rows in the salted join, each with a copy of its names
MAX_CENTRES = 256                     # clusters of a large reference
ANGLE_SLACK = 1e-6                    # rounding of cosines and angles in a bound


def check_threshold(threshold: float) -> float:
    if threshold is None or not 0 <= threshold <= 1:
        raise ValueError("Threshold must be between 0 and 1.")
    return float(threshold)


def _matrix(values, dim: int) -> np.ndarray:
    """Rows of an Arrow list column (no nulls) or a sequence of vectors as one matrix."""
    if isinstance(values, pa.Array):
        lengths = values.value_lengths().to_numpy(zero_copy_only=False)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    else:
        lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
        flat = np.concatenate([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros(0)
    if (lengths != dim).any():
        raise ValueError(f"vector of length {lengths[lengths != dim][0]} where {dim} was expected")
    return flat.reshape(len(lengths), dim)


def _similarities(x: np.ndarray, ref: np.ndarray, ref_norm: np.ndarray) -> np.ndarray:
    """Cosine matrix, 0 where either side has zero norm, rounded (in place: two matrices
    of that size are held)."""
    sim = x @ ref.T
    denom = np.outer(np.sqrt(np.einsum("ij,ij->i", x, x)), ref_norm)
    zero = denom == 0.0
    np.divide(sim, denom, out=sim, where=~zero)
    sim[zero] = 0.0
    return np.round(sim, SCORE_DECIMALS, out=sim)


def reference_stats(reference: DataFrame, vec: str = "embedding"):
    """(rows with a vector, dimension) of a reference table: one small aggregate job."""
    row = reference.agg(F.count(vec).alias("n"), F.max(F.size(vec)).alias("d")).first()
    return int(row["n"]), int(row["d"] or 0)


def reference_report(reference: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: reference rows, and those left out because they have no vector."""
    return reference.agg(F.count(F.lit(1)).alias("n_reference"), F.count_if(F.col(vec).isNull()).alias("n_without_vector"))


def _best(x: np.ndarray, mat: np.ndarray, block_bytes: int):
    """(position, score) of the first best reference row for each row of ``x``, by square
    tiles; a matrix of single precision is widened tile by tile."""
    side = max(1, math.isqrt(min(block_bytes, TILE_BYTES) // 8))
    best, score = np.full(len(x), -1, np.int64), np.full(len(x), -np.inf)
    for m in range(0, len(mat), side):
        part = mat[m:m + side].astype(np.float64, copy=False)
        norm = np.sqrt(np.einsum("ij,ij->i", part, part))
        for s in range(0, len(x), side):
            sim = _similarities(x[s:s + side], part, norm)
            j = sim.argmax(axis=1)  # first maximum: rows are in reference order
            top, cut = sim[np.arange(len(sim)), j], slice(s, s + side)
            better = top > score[cut]  # an equal score keeps the earlier tile
            best[cut] = np.where(better, m + j, best[cut])
            score[cut] = np.where(better, top, score[cut])
    return best, score


def _search_udf(slices, dim: int, block_bytes: int):
    """Arrow UDF: vector -> (reference row, score) over the broadcast slices."""
    def search(vec: pa.Array) -> pa.Array:
        ok = vec.is_valid().to_numpy(zero_copy_only=False)
        row, score = np.full(len(vec), -1, np.int64), np.full(len(vec), -np.inf)
        if ok.any():
            x = _matrix(vec.drop_null(), dim)
            best_row, best_score = np.full(len(x), -1, np.int64), np.full(len(x), -np.inf)
            for bc in slices:
                rows, mat = bc.value
                j, sc = _best(x, mat, block_bytes)
                better = sc > best_score  # an equal score keeps the earlier slice
                best_row[better], best_score[better] = rows[j[better]], sc[better]
            row[ok], score[ok] = best_row, best_score
        return pa.StructArray.from_arrays([pa.array(row, mask=~ok), pa.array(score, mask=~ok)], names=["row", "score"])

    # Marked non-deterministic only so the optimizer never copies the GEMM
    # into a pushed-down filter or a collapsed projection (it would then run
    # once per reference to a result field).  The function itself is pure.
    return F.arrow_udf(search, "row long, score double").asNondeterministic()


def _similarity_udf(slices, dim: int):
    """Arrow UDF: vector -> all similarities in reference order."""
    def every(vec: pa.Array) -> pa.Array:
        ok = vec.is_valid().to_numpy(zero_copy_only=False)
        mats = [bc.value[1] for bc in slices]
        m = sum(len(x) for x in mats)
        sim = np.zeros((int(ok.sum()), m))
        if len(sim):
            x = _matrix(vec.drop_null(), dim)
            mats = [r.astype(np.float64, copy=False) for r in mats]
            sim = np.concatenate([_similarities(x, r, np.sqrt(np.einsum("ij,ij->i", r, r))) for r in mats], axis=1)
        ends = np.concatenate(([0], np.cumsum(np.where(ok, m, 0))))
        mask = pa.array(np.append(~ok, False))
        offsets = pa.array(ends.astype(np.int32), mask=mask.to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(offsets, pa.array(sim.ravel()))

    return F.arrow_udf(every, "array<double>").asNondeterministic()


def _numbered(reference: DataFrame, ref_key: str, class_col: str, node_col: str, vec: str) -> DataFrame:
    """Reference rows with a vector and an internal number, written once: the
    search, the size check and the final join read the same numbers."""
    checkpoint_dir(reference.sparkSession)
    return (reference.where(F.col(vec).isNotNull())
            .select(F.monotonically_increasing_id().alias("__row"), F.col(ref_key).cast("long").alias("best_ref_id"),
                    F.col(class_col).cast("string").alias("best_class"),
                    F.col(node_col).cast("string").alias("best_node"), F.col(vec).cast("array<double>").alias("__vec"))
            .checkpoint(eager=True))


def _narrow(mat: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        single = mat.astype(np.float32)
    return single if np.array_equal(single, mat, equal_nan=True) else mat


def _broadcast_slices(ref: DataFrame, dim: int, block_bytes: int):
    """The vectors in ``ref_id`` order, in broadcast slices (the total is within
    the checked budget).  Every worker holds a copy, so numbers that single precision
    holds exactly (a table of floats) are sent as such."""
    t = ref.select("best_ref_id", "__row", "__vec").orderBy("best_ref_id", "__row").toArrow()
    rows, mat = t.column("__row").to_numpy(), _matrix(t.column("__vec").combine_chunks(), dim)
    mat = _narrow(mat)
    step = max(1, block_bytes // (8 * max(1, dim)))
    sc = ref.sparkSession.sparkContext
    return [sc.broadcast((rows[i:i + step], mat[i:i + step])) for i in range(0, len(rows), step)]


def release(matches: DataFrame) -> None:
    """Destroy the broadcasts behind a result of ``match`` that is no longer used."""
    for bc in getattr(matches, "_broadcasts", ()):
        bc.destroy()


def match(corpus: DataFrame, reference: DataFrame, *, key: str = "doc_id",
          vec: str = "embedding", ref_key: str = "ref_id", class_col: str = "class",
          node_col: str = "node", keep_all: bool = False,
          max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
          block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame:
    """Corpus columns + ``best_ref_id, best_class, best_node, similarity_score``
    (+ ``all_similarities`` in ``ref_id`` order when ``keep_all``).

    The best match does not depend on the threshold, so this table is computed
    once and every threshold (``apply_threshold``, the sweep) reads it.
    ``keep_all`` writes one number per reference and row; use it for a stated
    set of query rows, not for a corpus."""
    ref = _numbered(reference, ref_key, class_col, node_col, vec)
    n_ref, dim = reference_stats(ref, "__vec")
    if n_ref == 0:
        raise ValueError("The reference set is empty.")
    fits = n_ref * dim * 8 <= max_broadcast_bytes
    slices = _broadcast_slices(ref, dim, block_bytes) if fits or corpus.isStreaming else []
    # an explicit array<double>: the UDF reads Arrow buffers of doubles
    vectors = F.col(vec).cast("array<double>")
    if slices:
        found = corpus.withColumn("__match", _search_udf(slices, dim, block_bytes)(vectors))
        if keep_all:
            found = found.withColumn("all_similarities", _similarity_udf(slices, dim)(vectors))
        found = found.withColumns({"__row": F.col("__match.row"), "similarity_score": F.col("__match.score")}).drop("__match")
    else:
        corpus_rows = corpus.withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
        if keep_all:
            found = _blocked(corpus_rows, ref, vec, n_ref, dim, block_bytes)
        else:
            best = tree_search(corpus_rows.select("__id", vectors.alias("__vec")), ref, n_ref, dim, block_bytes).drop("cells")
            found = corpus_rows.join(best, "__id", "left").drop("__id")
    salt = [c for c in (key, vec) if c in corpus.columns]
    out = _named(found, ref.drop("__vec"), salt, min(max_broadcast_bytes, MAX_NAME_BYTES)).select(
        *[F.col(f"`{c}`") for c in corpus.columns], "best_ref_id", "best_class", "best_node", "similarity_score",
        *(["all_similarities"] if keep_all else []))
    out._broadcasts = slices
    return out


def _named(found: DataFrame, names: DataFrame, salt: list[str], budget: int) -> DataFrame:
    """Class and node of the winner: broadcast within ``budget`` bytes, else salted."""
    text = F.coalesce(F.octet_length("best_class"), F.lit(0)) + F.coalesce(F.octet_length("best_node"), F.lit(0))
    if (names.agg(F.sum(text + 64)).first()[0] or 0) <= budget:
        return found.join(F.broadcast(names), "__row", "left")
    names = names.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = found.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt]), F.lit(SALTS)))
    return found.join(names, ["__row", "__salt"], "left")


class _Tree(NamedTuple):
    """Clusters of a reference: the last one holds the zero vectors."""
    centres: np.ndarray     # unit vectors
    reach: np.ndarray       # widest angle of a cluster's references to its centre
    size: np.ndarray
    first: np.ndarray       # first bin of a cluster
    parts: np.ndarray       # bins that it takes

    def cosines(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return (x / np.where(norm > 0, norm, 1.0)[:, None]) @ self.centres.T

    def nearest(self, x: np.ndarray):
        """(cluster, its cosine) for references; zero vectors go to the last cluster."""
        cos = self.cosines(x)[:, :-1]
        c = cos.argmax(1)
        zero = ~x.any(1)
        return np.where(zero, len(self.centres) - 1, c).astype(np.int32), np.where(zero, 0.0, cos[np.arange(len(x)), c])

    def wanted(self, x: np.ndarray, best: np.ndarray | None) -> np.ndarray:
        """Rows x clusters: those to search first (``best`` is None), or those that may
        hold a score as good as ``best`` besides."""
        cos = self.cosines(x)
        own = np.where(self.size > 0, cos, -np.inf).argmax(1)
        zero = ~x.any(1)  # scores 0 everywhere: the smallest id of all clusters counts
        if best is None:
            want = np.zeros(cos.shape, bool)
            want[np.arange(len(x)), own] = True
            want[zero] = True
        else:
            want = self._bound(cos) + ANGLE_SLACK >= best[:, None]
            want[np.arange(len(x)), own] = False
            want[zero] = False
        return want & (self.size > 0)

    def reachable(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """Rows x clusters: those that may hold a score of at least ``threshold``."""
        want = self._bound(self.cosines(x)) + ANGLE_SLACK >= threshold
        want[~x.any(1)] = threshold <= 0
        return want & (self.size > 0)

    def _bound(self, cos: np.ndarray) -> np.ndarray:
        bound = np.cos(np.maximum(np.arccos(np.clip(cos, -1.0, 1.0)) - self.reach, 0.0))
        bound[:, -1] = 0.0
        return bound


def _reference_tree(ref: DataFrame, n_ref: int, dim: int, block_bytes: int):
    """(tree, reference rows with their cluster ``__c`` and bin ``__bin``)."""
    k = max(1, min(MAX_CENTRES, math.ceil(math.sqrt(n_ref))))
    unit = ref.select("__row", l2_normalize("__vec").alias("u")).where(F.exists("u", lambda x: x != 0))
    groups = coreset(unit, "__row", "u", rows=max(CORESET_ROWS, 4 * k))
    centres = np.zeros((1, dim)) if groups.isEmpty() else coreset_fits(groups, [(k, 0)], 0, 1e-3)[k]
    norm = np.sqrt((centres * centres).sum(1))
    centres = np.concatenate([centres / np.where(norm > 0, norm, 1.0)[:, None], np.zeros((1, dim))])
    zeros = np.zeros(len(centres), np.int64)
    tree = _Tree(centres, zeros, zeros, zeros, zeros)

    def near(vec: pa.Array) -> pa.Array:
        c, cos = tree.nearest(_matrix(vec, dim))
        return pa.StructArray.from_arrays([pa.array(c), pa.array(cos)], names=["c", "cos"])

    ref = ref.withColumn("__n", F.arrow_udf(near, "c int, cos double")("__vec")).select("__row", "best_ref_id", "__vec", "__n.c", "__n.cos")
    stats = ref.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).collect()
    size, reach = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in stats:
        size[r["c"]], reach[r["c"]] = r["n"], math.acos(max(-1.0, min(1.0, r["cos"])))
    first, parts, bin_, full = zeros.copy(), zeros + 1, 0, 0
    for c, n in enumerate(size.tolist()):
        parts[c] = max(1, math.ceil(n * dim * 8 / block_bytes))
        if full and full + n * dim * 8 > block_bytes:
            bin_, full = bin_ + 1, 0
        first[c], bin_, full = bin_, bin_ + int(parts[c]) - 1, full + n * dim * 8
        if parts[c] > 1:
            bin_, full = bin_ + 1, 0
    spot = [F.array(*[F.lit(int(v)) for v in a]) for a in (first, parts)]
    ref = ref.withColumn("__bin", spot[0][F.col("c")] + F.pmod(F.xxhash64("__row"), spot[1][F.col("c")]).cast("int"))
    return tree._replace(reach=reach, size=size, first=first, parts=parts), ref


def _by_bins(asked: DataFrame, ref: DataFrame, sent, wanted, meet, schema: str, dim: int, block_bytes: int) -> DataFrame:
    """``meet(rows, references)`` for every bin and chunk of the rows ``(__id, __vec, ...)``
    that have to meet it; ``wanted(tree, vectors, batch)`` says which clusters those are."""
    def route(batches):
        """A row once per bin that holds clusters it has to meet, with their numbers."""
        for b in batches:
            if not b.num_rows:
                continue
            t = sent.value
            want = wanted(t, _matrix(b.column(1), dim), b)
            for bin_ in range(int((t.first + t.parts).max())):
                held = np.flatnonzero((t.first <= bin_) & (bin_ < t.first + t.parts))
                at = np.flatnonzero(want[:, held].any(1))
                if len(at):
                    i, c = np.nonzero(want[np.ix_(at, held)])
                    ends = np.searchsorted(i, np.arange(len(at) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), bin_, np.int32)),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(held[c].astype(np.int32)))],
                        names=["__id", "__vec", "__bin", "clusters"])

    routed = asked.mapInArrow(route, "__id long, __vec array<double>, __bin int, clusters array<int>")
    chunks = [(r["__bin"], max(1, math.ceil(r["count"] * dim * 8 / block_bytes))) for r in routed.groupBy("__bin").count().collect()]
    sizes = F.broadcast(asked.sparkSession.createDataFrame(chunks, "__bin int, __chunks int"))  # one row per bin
    q = routed.join(sizes, "__bin").withColumn("__cb", F.pmod(F.xxhash64("__id"), F.col("__chunks")).cast("int")).drop("__chunks")
    r = ref.join(sizes, "__bin").withColumn("__cb", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks", "cos")
    return q.groupBy("__bin", "__cb").cogroup(r.groupBy("__bin", "__cb")).applyInArrow(meet, schema)


def _asked(q: pa.Table):
    """(row position, cluster) of every cluster that the rows of a bin ask for."""
    lists = q.column("clusters").combine_chunks()
    return np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def tree_search(rows: DataFrame, ref: DataFrame, n_ref: int, dim: int, block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame:
    """``(__id, __row, similarity_score, cells)`` of the best reference of every row
    ``(__id, __vec)`` that has a vector; ``cells`` counts the similarities computed."""
    tree, ref = _reference_tree(ref, n_ref, dim, block_bytes)
    rows = rows.where(F.col("__vec").isNotNull())
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def wanted(t: _Tree, x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return t.wanted(x, b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else None)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        n = q.num_rows if r.num_rows else 0
        row, ref_id, score, cells = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, np.int64)
        if n:
            r = r.sort_by([("best_ref_id", "ascending"), ("__row", "ascending")])
            x, mat = (_matrix(t.column("__vec").combine_chunks(), dim) for t in (q, r))
            own, rid = r.column("c").to_numpy(), r.column("__row").to_numpy()
            key = r.column("best_ref_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
            owner, asked = _asked(q)
            for c in np.unique(own):
                at, here = owner[asked == c], np.flatnonzero(own == c)
                if not len(at):
                    continue
                j, s = _best(x[at], mat[here], block_bytes)
                k, i = key[here][j], rid[here][j]
                cells[at] += len(here)
                tie = (s == score[at]) & ((k < ref_id[at]) | (k == ref_id[at]) & (i < row[at]))
                win = (s > score[at]) | tie
                row[at[win]], ref_id[at[win]], score[at[win]] = i[win], k[win], s[win]
        keep = cells > 0
        return pa.table({"__id": q.column("__id").filter(pa.array(keep)) if n else pa.array([], pa.int64()), "__row": row[keep],
                         "ref": ref_id[keep], "similarity_score": score[keep], "cells": cells[keep]})

    def search(asked: DataFrame) -> DataFrame:
        return _by_bins(asked, ref, sent, wanted, meet, "__id long, __row long, ref long, similarity_score double, cells long",
                        dim, block_bytes)

    def winners(parts: DataFrame) -> DataFrame:
        order = F.struct("similarity_score", -F.col("ref"), -F.col("__row"))
        return (parts.groupBy("__id").agg(F.max_by(F.struct("__row", "ref", "similarity_score"), order).alias("w"), F.sum("cells").alias("cells"))
                .select("__id", "w.*", "cells"))

    near = winners(search(rows)).checkpoint(eager=True)
    more = search(rows.join(near.select("__id", "similarity_score"), "__id"))
    out = winners(near.unionByName(more)).drop("ref").checkpoint(eager=True)
    sent.destroy()
    return out


def similar_pairs(corpus: DataFrame, reference: DataFrame, threshold: float, *, key: str = "doc_id", vec: str = "embedding",
                  ref_key: str = "ref_id", class_col: str = "class", block_bytes: int = PAIR_BLOCK_BYTES) -> DataFrame:
    """``(key, ref_id, class, similarity)`` of every corpus row and reference whose cosine
    is at least ``threshold``; rows and references without a vector are in no pair.

    A row meets only the clusters of the reference whose angle bound reaches the
    threshold.  A task holds ``block_bytes`` of rows and of references, which bounds its
    pairs.  The result is written when called."""
    t = check_threshold(threshold)
    spark = corpus.sparkSession
    ref = _numbered(reference, ref_key, class_col, class_col, vec)
    n_ref, dim = reference_stats(ref, "__vec")
    rows = corpus.select(F.col(key).alias("__key"), F.col(vec).cast("array<double>").alias("__vec")).where(F.col("__vec").isNotNull())
    rows = rows.withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
    if n_ref == 0:
        rows = rows.limit(0)
    tree, placed = _reference_tree(ref, n_ref, dim, block_bytes)
    sent = spark.sparkContext.broadcast(tree)

    def wanted(tree: _Tree, x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return tree.reachable(x, t)

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and r.num_rows:
            x, mat = (_matrix(v.column("__vec").combine_chunks(), dim) for v in (q, r))
            ids, rid, own = q.column("__id").to_numpy(), r.column("__row").to_numpy(), r.column("c").to_numpy()
            owner, asked = _asked(q)
            for c in np.unique(own):
                at, here = owner[asked == c], np.flatnonzero(own == c)
                sim = _similarities(x[at], mat[here], np.sqrt(np.einsum("ij,ij->i", mat[here], mat[here])))
                i, j = np.nonzero(sim >= t)
                out.append((ids[at[i]], rid[here[j]], sim[i, j]))
        cols = [np.concatenate(v) for v in zip(*out)]
        return pa.table({"__id": cols[0], "__row": cols[1], "similarity": cols[2]})

    pairs = _by_bins(rows.select("__id", "__vec"), placed, sent, wanted, meet, "__id long, __row long, similarity double",
                     dim, block_bytes).checkpoint(eager=True)
    sent.destroy()
    found = pairs.join(rows.select("__id", "__key"), "__id")
    return _named(found, ref.drop("__vec"), ["__id"], MAX_NAME_BYTES).select(
        F.col("__key").alias(key), F.col("best_ref_id").alias("ref_id"), F.col("best_class").alias("class"), "similarity")


def _blocked(corpus: DataFrame, ref: DataFrame, vec: str, n_ref: int, dim: int, block_bytes: int) -> DataFrame:
    """Corpus columns + ``__row``, ``similarity_score`` and ``all_similarities`` by
    reference blocks, for corpus rows with a number ``__id``."""
    spark = corpus.sparkSession
    ref_blocks = max(1, math.ceil(n_ref * dim * 8 / block_bytes))
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 math.ceil(corpus.count() * dim * 8 / block_bytes))
    ref_side = (ref.select("__row", "best_ref_id", "__vec")
                .withColumn("__rb", F.pmod(F.xxhash64("__row"), F.lit(ref_blocks)))
                .withColumn("__cb", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    q_side = (corpus.select("__id", F.col(vec).cast("array<double>").alias("__vec")).where(F.col("__vec").isNotNull())
              .withColumn("__cb", F.pmod(F.xxhash64("__id"), F.lit(chunks)))
              .withColumn("__rb", F.explode(F.sequence(F.lit(0), F.lit(ref_blocks - 1)))))

    def block(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"__id": pa.array([], pa.int64()), "__row": pa.array([], pa.int64()),
                             "best_ref_id": pa.array([], pa.int64()), "similarity_score": pa.array([], pa.float64())})
        r = r.sort_by([("best_ref_id", "ascending"), ("__row", "ascending")])
        j, score = _best(_matrix(q.column("__vec").combine_chunks(), dim), _matrix(r.column("__vec").combine_chunks(), dim),
                         block_bytes)
        return pa.table({"__id": q.column("__id"), "__row": r.column("__row").take(pa.array(j)),
                         "best_ref_id": r.column("best_ref_id").take(pa.array(j)), "similarity_score": pa.array(score)})

    pairs = q_side.groupBy("__rb", "__cb").cogroup(ref_side.groupBy("__rb", "__cb"))
    partial = pairs.applyInArrow(block, "__id long, __row long, best_ref_id long, similarity_score double")
    best = partial.groupBy("__id").agg(F.max_by(
        F.struct("__row", "similarity_score"),
        F.struct("similarity_score", -F.col("best_ref_id"), -F.col("__row"))).alias("__w"))
    found = corpus.join(best.select("__id", "__w.*"), "__id", "left")
    cell = pa.struct([("best_ref_id", pa.int64()), ("__row", pa.int64()), ("s", pa.float64())])

    def every(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"__id": pa.array([], pa.int64()), "cells": pa.array([], pa.list_(cell))})
        mat = _matrix(r.column("__vec").combine_chunks(), dim)
        sim = _similarities(_matrix(q.column("__vec").combine_chunks(), dim), mat, np.sqrt(np.einsum("ij,ij->i", mat, mat)))
        n, m = sim.shape
        at = pa.array(np.tile(np.arange(m), n))
        cells = pa.StructArray.from_arrays([r.column("best_ref_id").combine_chunks().take(at), r.column("__row").combine_chunks().take(at),
                                            pa.array(sim.ravel())], fields=list(cell))
        return pa.table({"__id": q.column("__id"),
                         "cells": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), cells)})

    cells = pairs.applyInArrow(every, "__id long, cells array<struct<best_ref_id:long,__row:long,s:double>>")
    rows = cells.groupBy("__id").agg(F.transform(F.array_sort(F.flatten(F.collect_list("cells"))), lambda x: x["s"])
                                     .alias("all_similarities"))
    found = found.join(rows, "__id", "left")
    return found.drop("__id")


def apply_threshold(matches: DataFrame, threshold: float, *, score_col: str = "similarity_score",
                    class_col: str = "best_class", node_col: str = "best_node") -> DataFrame:
    """``predicted_class``/``matched_node``: the best match when its score is
    ``>= threshold``, else ``"Other"`` and ``""`` (the score is kept)."""
    t = check_threshold(threshold)
    s = F.col(score_col)
    hit = s >= F.lit(t)
    return matches.withColumns({
        "predicted_class": F.when(s.isNull(), F.lit(None).cast("string"))
                            .when(hit, F.col(class_col)).otherwise(F.lit(OTHER)),
        "matched_node": F.when(s.isNull(), F.lit(None).cast("string"))
                         .when(hit, F.col(node_col)).otherwise(F.lit("")),
    })


def match_rate(matches: DataFrame, threshold: float, score_col: str = "similarity_score") -> DataFrame:
    """One row: rows, matches at or above the threshold, and their share."""
    t = check_threshold(threshold)
    hit = (F.col(score_col) >= F.lit(t))
    return matches.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_if(hit).alias("n_matched"),
                       F.avg(hit.cast("double")).alias("match_share"))


def class_distribution(df: DataFrame, class_col: str = "predicted_class", top: int | None = None) -> DataFrame:
    """Counts per predicted class, largest first (ties by class name); all
    classes, or the ``top`` first ones for a display."""
    out = (df.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("class")))
    return out.limit(top) if top else out


def avg_similarity_by_class(df: DataFrame, class_col: str = "predicted_class",
                            score_col: str = "similarity_score") -> DataFrame:
    return (df.groupBy(F.col(class_col).alias("class"))
            .agg(F.avg(score_col).alias("avg_similarity"), F.count(F.lit(1)).alias("n"))
            .orderBy("avg_similarity", "class"))
