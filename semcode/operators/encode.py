"""Text -> vector as distributed batch jobs.

* ``hashed_encode`` — the built-in encoder: lower-cased word tokens, each
  hashed by md5 into one of ``dim`` buckets, counted, L2-normalised.  Lexical,
  not semantic; it exists so that the whole workflow runs and can be checked
  without model weights.  Tokens and their md5 buckets are computed in the JVM;
  a small Arrow UDF turns each row's bucket list into counts (``bincount``).
  One narrow stage, no shuffle.
* ``encode_with`` — host for any encoder ``encode(list[str]) -> array (n, d)``:
  an iterator Arrow UDF builds the encoder once per task and feeds it fixed
  batches.  With ``dedupe=True`` each distinct text is encoded once and joined
  back by its md5 (real corpora repeat lines; AQE's skew join splits a hot
  repeated text).
* ``encode_remote`` — a rate-limited remote service behind an injected client:
  fixed batches, retries with doubling back-off on quota errors, a pause
  between batches, and a per-row status; a missing vector stays null instead
  of shifting the rows after it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from semcode.functions.hashing import md5_u32
from semcode.functions.text import word_tokens

DEFAULT_DIM = 64

# Fixed values from the reference's remote path: 3 attempts, 2 s first
# back-off (doubling), 1 s pause between batches, quota error markers.
REMOTE_ATTEMPTS = 3
REMOTE_BACKOFF_S = 2.0
REMOTE_PAUSE_S = 1.0
QUOTA_MARKERS = ("429", "RESOURCE_EXHAUSTED")


def token_buckets(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """ARRAY<INT> of md5 buckets of the word tokens (JVM side)."""
    return F.transform(word_tokens(text), lambda t: (md5_u32(t) % F.lit(dim)).cast("int"))


def _bincount_udf(dim: int):
    """Bucket lists to unit count vectors, one ``bincount`` per batch."""
    def counts_to_unit(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        lists = buckets if not buckets.null_count else pc.fill_null(buckets, [])
        rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = rows * dim + lists.flatten().to_numpy(zero_copy_only=False)
        c = np.bincount(at, minlength=n * dim).astype(np.float64).reshape(n, dim)
        norm = np.sqrt(np.einsum("ij,ij->i", c, c))
        c /= np.where(norm > 0, norm, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(c.ravel()))
    return F.arrow_udf(counts_to_unit, "array<double>")


def hashed_encode(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
                  dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``out_col`` ARRAY<DOUBLE>: unit-length token-count vector (zero
    vector for a text without tokens; null text is encoded as "")."""
    return df.withColumn(out_col, _bincount_udf(dim)(token_buckets(text_col, dim)))


def hashed_counts_long(df: DataFrame, key: str, text_col: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """Pure-SQL form of the same encoder, long: ``(key, bucket, value)`` with
    value = count / norm (the self-check plan; shuffles on the key)."""
    ex = df.select(key, F.explode(token_buckets(text_col, dim)).alias("bucket"))
    counts = ex.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("c") / norm).alias("value"))


def encode_with(df: DataFrame, text_col: str, encoder_factory: Callable[[], Callable],
                out_col: str = "embedding", batch_size: int = 32,
                dedupe: bool = False) -> DataFrame:
    """Encode ``text_col`` with any batch encoder.

    ``encoder_factory()`` runs once per task (load weights there) and returns
    ``encode(list[str]) -> np.ndarray (n, d)``.  Null text is encoded as "".
    With ``dedupe`` each distinct text is encoded once: texts meet by a 128-bit
    hash, and only the hash and the vector travel back to the rows.
    """
    if text_col not in df.columns:
        raise ValueError(f"Missing column: {text_col}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_factory()
        for texts in batches:
            texts = texts.fillna("").astype(str).tolist()
            vecs = []
            for s in range(0, len(texts), batch_size):
                v = np.asarray(encode(texts[s:s + batch_size]), dtype=np.float64)
                vecs.extend(list(v))
            yield pd.Series(vecs, dtype=object)

    if not dedupe:
        return df.withColumn(out_col, run(F.col(text_col)))
    h = "__text_md5"
    keyed = df.withColumn(h, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    distinct = (keyed.groupBy(h).agg(F.first(text_col).alias("__text"))
                .select(h, run(F.col("__text")).alias(out_col)))
    return keyed.join(distinct, h, "left").drop(h)


def hashing_encoder(dim: int = DEFAULT_DIM) -> Callable[[list], np.ndarray]:
    """The built-in hashed encoder as a batch function for ``encode_with``;
    every distinct word of a batch is hashed once."""
    import hashlib

    import regex
    split = regex.compile(r"[^\p{L}\p{N}]+").split

    def encode(texts):
        words = [[w for w in split((t or "").lower()) if w] for t in texts]
        bucket = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in {w for ws in words for w in ws}}
        at = np.array([i * dim + bucket[w] for i, ws in enumerate(words) for w in ws], np.int64)
        c = np.bincount(at, minlength=len(words) * dim).astype(np.float64).reshape(len(words), dim)
        norm = np.sqrt(np.einsum("ij,ij->i", c, c))
        return c / np.where(norm > 0, norm, 1.0)[:, None]
    return encode


def l2_normalize_col(df: DataFrame, col: str = "embedding", out_col: str | None = None) -> DataFrame:
    from semcode.functions.vectors import l2_normalize
    return df.withColumn(out_col or col, l2_normalize(col))


def mean_pool(tokens: DataFrame, key: str, pos_col: str, vec_col: str, mask_col: str,
              out_col: str = "embedding") -> DataFrame:
    """Masked mean of token vectors per ``key``: sum(x * m) / max(sum(m), 1e-9),
    element-wise; a key without any masked vector gets zeros.  Vectors are
    summed whole (MLlib ``Summarizer``, map-side combine), never exploded."""
    m = F.col(mask_col).cast("double")
    t = tokens.select(key, m.alias("_m"), F.col(vec_col).alias("_x"))
    mean = (t.where(F.col("_m") > 0)
            .groupBy(key).agg(Summarizer.mean(array_to_vector("_x"), F.col("_m")).alias("_v"), F.sum("_m").alias("_w"))
            .select(F.col(key).alias("_k"), vector_to_array("_v").alias("_v"),
                    (F.col("_w") / F.greatest("_w", F.lit(1e-9))).alias("_w")))
    keys = t.groupBy(key).agg(F.max(F.size("_x")).alias("_d"))
    out = F.coalesce(F.transform("_v", lambda x: x * F.col("_w")), F.array_repeat(F.lit(0.0), F.col("_d")))
    return keys.join(mean, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, out.alias(out_col))


def request_plan(n_texts: Column, per_request: int = 100) -> Column:
    """Requests needed for a remote encoder (the reference's estimate)."""
    return (F.floor(n_texts / F.lit(per_request)) + 1).cast("bigint")


def encode_remote(df: DataFrame, key: str, text_col: str, client_factory: Callable[[], object],
                  dim: int, batch_size: int = 32, concurrency: int | None = None,
                  pause_s: float = REMOTE_PAUSE_S, backoff_s: float = REMOTE_BACKOFF_S,
                  attempts: int = REMOTE_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The columns of ``df`` with ``embedding`` and ``status`` from a remote service.

    ``client_factory()`` returns an object with ``embed(list[str]) ->
    list[list[float]]``.  By default every partition calls the service; a
    shared quota can be respected by ``concurrency`` (that many partitions call
    at once).  Quota errors are retried with
    back-off; other errors are raised; rows that a short or empty reply leaves
    out are null with status ``"missing"``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("status", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        first = True
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                texts = part[text_col].fillna("").astype(str).tolist()
                if not first and pause_s:
                    sleep(pause_s)
                first = False
                vecs = list(_with_retry(lambda: client.embed(texts), attempts, backoff_s, sleep) or [])[:len(texts)]
                vecs += [None] * (len(texts) - len(vecs))
                yield part.assign(embedding=pd.Series([None if v is None else np.asarray(v, np.float64) for v in vecs],
                                                      index=part.index, dtype=object),
                                  status=["missing" if v is None else "ok" for v in vecs])

    src = df
    if concurrency:
        src = src.repartition(concurrency)
    return src.mapInPandas(call, schema)


def _with_retry(fn, attempts, backoff_s, sleep):
    delay = backoff_s
    for i in range(attempts):
        try:
            return fn()
        except Exception as e:  # noqa: BLE001
            quota = any(m in str(e) for m in QUOTA_MARKERS)
            if not quota or i == attempts - 1:
                raise
            sleep(delay)
            delay *= 2
    return None
