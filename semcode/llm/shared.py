"""Small Spark helpers of the subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcode.llm.bytesnp import forget_powers
from semcode.session import checkpoint_dir

_WRITTEN: dict = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut, and a lost executor re-reads the files instead of
    recomputing.  (``checkpoint()`` would run the last stage twice.)  The files
    go with ``discard``, or when the session's process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_clean)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = spark
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing lazy reads any more."""
    path = getattr(df, "_written", None)
    if path in _WRITTEN:
        _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


def tidy(run):
    """``run`` (a function on Arrow batches), giving memory back when its task ends:
    workers are reused and would hold it while other stages need it."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def give_back() -> None:
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its free lists
        pass


#: edges that one union-find of the forest pass holds
FOREST_EDGES = 1 << 21


def _edge_batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forest(batches):
    """Edges of a partition to (node, smallest node it is joined to)."""
    def united(held):
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, up = at[:len(a)], at[len(a):], np.arange(len(nodes))
        while True:
            lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
            if (lo == hi).all():
                break
            np.minimum.at(up, hi, lo)
            while (up[up] != up).any():
                up = up[up]
        low = np.flatnonzero(up != np.arange(len(nodes)))
        return _edge_batch(nodes[low], nodes[up[low]])

    held, rows = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        rows += x.num_rows
        if rows >= FOREST_EDGES:
            yield united(held)
            held, rows = [], 0
    if rows:
        yield united(held)


def _star(large: bool):
    """One star step over rows sorted by (a, b): the least of a and its neighbours (of
    its smaller neighbours) takes the larger neighbours (the smaller ones and a).  Groups
    stream by; only the last row is held."""
    def run(batches):
        last = None
        for x in batches:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            if not len(a):
                continue
            new, again = np.ones(len(a), bool), np.zeros(len(a), bool)
            new[1:], again[1:] = a[1:] != a[:-1], (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            if last is not None:
                new[0], again[0] = a[0] != last[0], a[0] == last[0] and b[0] == last[1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            low = (np.minimum(a, b) if large else b)[at]
            if last is not None:
                low = np.where(at < 0, last[2], low)
            last = a[-1], b[-1], low[-1]
            if large:
                out = (b > a) & (b != low) & ~again
                yield _edge_batch(b[out], low[out])
            else:
                out = (b != low) & ~again
                yield _edge_batch(np.concatenate([b[out], a[new]]), np.concatenate([low[out], low[new]]))
    return run


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs.

    Each partition first reduces its edges to a forest (union-find); then large-star
    and small-star rounds, each one exchange with rows sorted inside the partitions
    and streamed, are written to the shared folder.  Only one number per round (a
    checksum of the edge table) reaches the driver.  Returns ``(node, component)``
    with the smallest node as the component; nodes without an edge do not appear.
    """
    def step(e, large):
        return e.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_star(large), "a long, b long")

    def mark(e):
        r = e.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e, old, seen = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), None, None
    for _ in range(max_rounds):
        both = step(e.withColumn("x", F.explode(F.expr("array(struct(a, b), struct(b as a, a as b))"))).select("x.*"), True)
        e = materialize(step(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), name)
        if old is not None:
            discard(old)
        now = mark(e)
        if now == seen:
            break
        old, seen = e, now
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
