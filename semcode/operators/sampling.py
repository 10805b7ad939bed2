"""Exact random and stratified samples for manual coding.

A row's random rank is ``md5_u32(seed:key)`` (ties by key): the sample is the
``quota`` lowest-ranked rows of each stratum — a pure function of the data,
the seed and the key, identical on any cluster layout.

Plan: a sort of the table would put every row through one ordering.  Instead
the rank's top 16 bits name one of 65,536 buckets; ``groupBy(stratum,
bucket).count()`` (partial aggregation, tiny output) and a running sum per
stratum find the bucket where each quota is reached.  Rows in lower buckets
are taken whole by a filter; only rows of the one cut bucket per stratum are
ranked.  A stratum holding a third of the data is thus split 65,536 ways and
never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semcode.functions.hashing import md5_u32, seeded_key

BUCKET_BITS = 16
MAX_BROADCAST_STRATA = 1_000_000


def sample_size(n_rows: int, size) -> int:
    """Fraction (float in (0, 1], truncated) or row count (int in [1, n])."""
    if isinstance(size, bool):
        raise ValueError("Sample size must be an int or a float.")
    if isinstance(size, float):
        if not 0 < size <= 1:
            raise ValueError("Sample size as fraction must be between 0 and 1.")
        return int(n_rows * size)
    if not 0 < size <= n_rows:
        raise ValueError(f"Sample size must be between 1 and {n_rows}.")
    return int(size)


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    h = md5_u32(seeded_key(seed, key))
    return df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - BUCKET_BITS))


def bucket_counts(df: DataFrame, key: str, strata, seed: int) -> DataFrame:
    """``(strata..., _b, _c)``: rows per stratum and rank bucket — a partial +
    final aggregate whose size is bounded by strata x 65,536, whatever the
    data size.  It also yields N and every stratum size."""
    return _ranked(df, key, seed).groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))


def take_lowest(df: DataFrame, key: str, quotas: DataFrame, strata, seed: int,
                n_strata: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose rank is among the ``quota`` lowest of their stratum;
    ``quotas`` has the stratum columns and ``quota``."""
    strata = list(strata)
    r = _ranked(df, key, seed)
    counts = counts if counts is not None else bucket_counts(df, key, strata, seed)
    cum = (counts.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*strata).orderBy("_b")
                                                      .rowsBetween(Window.unboundedPreceding, 0)))
           .join(_bcast(quotas, n_strata), strata))
    # first bucket where the running count reaches the quota, and rows needed from it
    need = F.col("quota") - F.col("_cum") + F.col("_c")
    cut = (cum.where(F.col("_cum") >= F.col("quota"))
           .groupBy(*strata).agg(F.min_by(F.struct(F.col("_b"), need.alias("_need")), F.col("_b")).alias("_cut"))
           .select(*strata, F.col("_cut._b").alias("_cut_b"), F.col("_cut._need").alias("_need")))
    q = (quotas.join(cut, strata, "left")
         .select(*strata, F.coalesce("_cut_b", F.lit(1 << BUCKET_BITS)).alias("_cut_b"),
                 F.coalesce("_need", F.lit(0)).alias("_need")))
    tagged = r.join(_bcast(q, n_strata), strata)
    whole = tagged.where(F.col("_b") < F.col("_cut_b"))
    edge = (tagged.where(F.col("_b") == F.col("_cut_b"))
            .withColumn("_rk", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key)))
            .where(F.col("_rk") <= F.col("_need")).drop("_rk"))
    return whole.unionByName(edge).drop("_h", "_b", "_cut_b", "_need")


def _bcast(small: DataFrame, n: int | None) -> DataFrame:
    return F.broadcast(small) if n is not None and n <= MAX_BROADCAST_STRATA else small


def sample(df: DataFrame, sampling_type: str = "random", sample_size_=0.1,
           stratify_column: str | None = None, seed: int = 0, key: str = "doc_id",
           label_column: str | None = "Label") -> DataFrame:
    """Random or stratified sample with an exact size, plus an empty label
    column for coders (added only if absent).

    Stratified quotas follow the reference: ``max(1, int(n * share))`` capped
    at the stratum size, so the total can differ from n.

    The data is read three times: keys and strata alone for the bounded
    (stratum, rank-bucket) count table, which gives N, the stratum sizes and the
    cut buckets; then the rows below the cut buckets, and those of the cut
    buckets, which are ranked.
    """
    if sampling_type not in ("random", "stratified"):
        raise ValueError(f"Unknown sampling type: {sampling_type}")
    if sampling_type == "stratified":
        if stratify_column is None:
            raise ValueError("stratify_column must be provided for stratified sampling.")
        if stratify_column not in df.columns:
            raise ValueError(f"Stratification column '{stratify_column}' not found in DataFrame.")
        src, strata = df, [stratify_column]
    else:
        src, strata = df.withColumn("_s", F.lit(0)), ["_s"]
    # one pass over the data; the small count table is checkpointed to the
    # shared folder and every later step (N, stratum sizes, quotas, cut
    # buckets) reads it instead of the data
    counts = bucket_counts(src, key, strata, seed).checkpoint(eager=True)
    sizes = counts.groupBy(*strata).agg(F.sum("_c").alias("_cnt"))
    stats = sizes.agg(F.sum("_cnt").alias("n"), F.count(F.lit(1)).alias("k"),
                      F.sum(F.when(F.col(strata[0]).isNull(), F.col("_cnt"))).alias("nulls")).first()
    if stats["nulls"]:
        raise ValueError(f"NaN values found in stratification column '{stratify_column}'.")
    n_rows = int(stats["n"] or 0)
    n = sample_size(n_rows, sample_size_)
    quotas = stratum_quotas(sizes, strata[0], n, n_rows)
    quotas_cut = take_lowest(src, key, quotas, strata, seed, int(stats["k"]), counts=counts)
    out = quotas_cut.drop("_s") if sampling_type == "random" else quotas_cut
    if label_column and label_column not in out.columns:
        out = out.withColumn(label_column, F.lit(None).cast("string"))
    return out


def stratum_quotas(counts: DataFrame, stratum: str, n: int, n_rows: int) -> DataFrame:
    """``max(1, int(n * share))`` capped at the stratum size (double
    arithmetic, as the reference's float share)."""
    share = F.col("_cnt").cast("double") / F.lit(float(n_rows))
    q = F.greatest(F.lit(1), F.floor(F.lit(float(n)) * share).cast("long"))
    return counts.select(stratum, F.least(q, F.col("_cnt")).alias("quota"))


def sample_report(sample_df: DataFrame, stratify_column: str, n_requested: int) -> DataFrame:
    """Rows per stratum in the sample and their share of the requested size."""
    return (sample_df.groupBy(stratify_column).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / F.lit(float(n_requested))))
