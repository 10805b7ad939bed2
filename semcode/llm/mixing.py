"""Mixing sources to target token weights by entropy balancing.

Rates minimise the token-weighted relative entropy to the documents' prior
rates under one token constraint per source.  The convex dual has one variable
per source; its optimality condition is solved by Newton steps on the logarithm
of the tilted token sum (which cannot overshoot the way the raw sum does):

    rate_i = min(cap, prior_i * exp(lambda_s)),   mass_s = sum size_i rate_i
    lambda_s += log(target_s / mass_s) * mass_s / sum_{rate_i < cap} size_i rate_i

Documents are first summed to (source, prior) cells, so iterations run on that small
table.  Each step is a job of its own whose result is written, and the steps stop
when every source meets its target (one number per step reaches the driver); with
one prior per source the first step is exact.

Rates become copies by systematic rounding: within a source, documents are
ranked by (size, md5 of the id, id) and the fractional parts are accumulated by
rank, so the mix takes an even sample of every size and the error per source
stays about one document.  Of ``PHASES`` starting points of the accumulation,
each source takes the one that comes nearest to its target.  Ranks come from
counts by (source, size, hash bucket); no window holds a whole source or a whole
group of equal sizes.

Defined cases: null or empty text has size 0; null source is a source of its
own, sorted last; null ids hash as the text "null"; rows with the same id are
ranked next to each other; a corpus without words has targets 0 and takes
nothing; an empty table gives an empty table; extra columns are ignored by
``mix_plan`` and kept by ``mix``, which numbers the rows first, so that rows sharing
an id (or without one) each take their own copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcode.functions.hashing import md5_u32
from semcode.llm.shared import discard, materialize

#: weights of the sources in code-point order, repeating (fixed values)
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
NANO = 1_000_000_000
HASH_BUCKET = 1 << 20  # 4,096 buckets of the 32-bit hash
#: relative miss of a target at which the steps stop, and their largest number
CLOSE, NEWTON_STEPS = 1e-12, 60
PHASES = 16


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: ``share`` of all sizes by weight,
    capped at ``cap`` times the source's size, the excess reshared by weight.

    Capped sources are those with the smallest size-to-weight ratio, so the
    resharing has a closed form over that order.  The table has one row per
    source; the windows without a partition run over that table only."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = (sources.withColumn("weight", weight)
         .withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
         .withColumn("before", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))
         .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("unit", (F.lit(share) * F.col("total") - F.lit(cap) * F.col("before")) / F.col("rest")))
    unit = F.coalesce(F.min(F.when(F.col("unit") <= F.col("ratio"), F.struct("ratio", "unit"))).over(Window.partitionBy())
                      .getField("unit"), F.lit(float("inf")))
    return t.select("source", "source_size",
                    F.least(F.lit(cap) * F.col("source_size"), unit * F.col("weight")).alias("target"))


def newton_rates(cells: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """``(source, prior, rate)`` from cells ``(source, prior, size)`` and targets."""
    t = targets.select(F.col("source").alias("__s"), "target")
    x = (cells.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
         .withColumn("lam", F.lit(0.0)))
    rate = F.least(F.lit(cap), F.col("prior") * F.exp("lam"))
    sums = lambda c: F.sum(c).over(Window.partitionBy("source"))
    full = F.col("target") >= F.lit(cap) * sums(F.col("size"))
    old = None
    for _ in range(steps):
        x = (x.withColumn("mass", sums(F.col("size") * rate))
             .withColumn("free", sums(F.when(rate < cap, F.col("size") * rate).otherwise(0.0)))
             .withColumn("open", (F.col("target") > 0) & ~full & (F.abs(F.col("mass") - F.col("target")) > CLOSE * F.col("target")))
             .withColumn("lam", F.when(~F.col("open"), F.col("lam"))
                         .when(F.col("free") > 0, F.col("lam") + F.log(F.col("target") / F.col("mass")) * F.col("mass") / F.col("free"))
                         .when(F.col("mass") > F.col("target"), F.col("lam") - 0.5).otherwise(F.col("lam"))))
        x = materialize(x.select("source", "prior", "size", "target", "lam", "open"), "newton")
        if old is not None:
            discard(old)
        old = x
        if not x.where("open").take(1):
            break
    rate = F.when(full, F.lit(cap)).otherwise(rate)
    return x.select("source", "prior", F.when(F.col("target") > 0, rate).otherwise(0.0).alias("rate"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             share: float = SHARE, cap: float = CAP, row_col: str | None = None) -> DataFrame:
    """``(id_col, source, size, source_size, target, rate, copies, taken)`` per row, with
    the rows' number ``row_col`` if it is given."""
    row = [F.col(row_col).alias("__row")] if row_col else []
    sized = docs.select(F.col(id_col).alias("__id"), *row, F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                        md5_u32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h"))
    sized = sized.withColumn("bucket", F.expr(f"h div {HASH_BUCKET}")).withColumn("prior", F.lit(1.0))
    sized = materialize(sized, "sizes")  # texts are read once
    hist = sized.groupBy("source", "size", "bucket", "prior").agg(F.count("*").alias("n"))
    cells = hist.groupBy("source", "prior").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    sources = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, share, cap)
    rates = newton_rates(cells, targets, cap).join(
        targets.select(F.col("source").alias("__s"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # rank of a row in its source by (size, hash, id), from counts
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = hist.groupBy("source", "size").agg(F.sum("n").alias("n")).withColumn(
        "lower", F.coalesce(F.sum("n").over(before("source", "size")), F.lit(0)))
    buckets = hist.groupBy("source", "size", "bucket").agg(F.sum("n").alias("n")).withColumn(
        "inner", F.coalesce(F.sum("n").over(before("source", "size", "bucket")), F.lit(0)))
    same = lambda a, b, *cols: [a["source"].eqNullSafe(b["source"]), *[a[c] == b[c] for c in cols]]
    place = buckets.join(sizes, same(buckets, sizes, "size")).select(
        buckets["source"].alias("__s"), buckets["size"].alias("__z"), buckets["bucket"].alias("__b"),
        (F.col("lower") + F.col("inner")).alias("offset"))
    rates = rates.select(F.col("source").alias("__t"), F.col("prior").alias("__p"), "source_size", "target", "rate")
    ranked = (sized.join(place, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))
                         & (F.col("bucket") == F.col("__b")))
              .withColumn("rank", F.col("offset") + F.row_number().over(
                  Window.partitionBy("source", "size", "bucket").orderBy("h", "__id")))
              .join(rates, F.col("source").eqNullSafe(F.col("__t")) & (F.col("prior") == F.col("__p"))))
    # whole numbers from here on: billionths of a copy
    ranked = ranked.withColumn("nano", F.round(F.col("rate") * NANO).cast("long"))
    upto = lambda k, start: f"((rank - {k}) * (nano % {NANO}) + {start}) div {NANO}"
    copies = lambda start: F.expr(f"nano div {NANO} + {upto(0, start)} - {upto(1, start)}")
    starts = [p * (NANO // PHASES) for p in range(PHASES)]
    sums = ranked.groupBy("source").agg(F.first("target").alias("goal"), F.array(
        *[F.sum(F.col("size") * copies(p)) for p in starts]).alias("sums"))
    best = F.array_min(F.transform("sums", lambda x, i: F.struct(F.abs(x - F.col("goal")).alias("off"), i.alias("p"))))
    phase = sums.select(F.col("source").alias("__q"), (best["p"] * (NANO // PHASES)).cast("long").alias("start"))
    out = (ranked.join(phase, F.col("source").eqNullSafe(F.col("__q")))
           .withColumn("copies", copies("start")))
    return out.select(F.col("__id").alias(id_col), *([F.col("__row").alias(row_col)] if row_col else []), "source", "size", "source_size",
                      F.round("target", 6).alias("target"), "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row repeated by its copies (0 drops it).  The rows are
    numbered in a written copy, which both the plan and the repetition read."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    copies = mix_plan(rows, id_col, text_col, source_col, row_col="__row").where("copies > 0").select("__row", "copies")
    return (rows.join(copies, "__row").withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*docs.columns))
