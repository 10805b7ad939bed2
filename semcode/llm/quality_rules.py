"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per text: word and symbol counts, repeated lines and repeated 5-word windows.
Instead of fixed cutoffs, the verdict compares each ratio with an outlier fence
of its own language and source:

* the sketch of a group is a histogram over logarithmic buckets (relative error
  ``(GAMMA - 1) / 2``).  It is deterministic, its size does not grow with the
  rows, and sketches merge by adding counts: (language, source) sketches add up
  to language sketches, and those to the corpus sketch;
* a group's quantiles are blended with those of the level above, weighted by its
  rows against ``prior_rows``: a small group leans on its language and the corpus, a
  large one stands for itself, and no size switches from one to the other;
* fences are the blended quartiles plus or minus ``REACH`` times the spread, where
  the spread is the interquartile range, at least that of a normal distribution with
  the same 10 % and 90 % points, widened by the sketch's relative error.  No fixed
  ratio bounds them;
* counts are small whole numbers, so ``REACH`` events of each kind are free: a text
  with one symbol is no outlier among texts without any;
* thresholds (one row per group) are joined to the per-document counts.

Defined cases: null or empty text has no words and fails the base rules; null
language or source is a group of its own; rows are judged one by one, repeated
or not; texts that fail the base rules feed no sketch; a corpus without any
passing text has no thresholds and rejects nothing more; an empty table gives
an empty table; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcode.llm.shared import materialize

#: characters of a word separator, of a symbol (fixed values)
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
GAMMA = 1.02
ZERO = -100_000  # bucket of the value 0
REACH = 3.0
TAIL = 1.9  # distance of the 10 % and 90 % points of a normal distribution, in interquartile ranges
PRIOR_ROWS = 200
QUANTILES = {"q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9}
#: metric: (count, per, size of one event, fence below as well)
METRICS = {
    "symbol_ratio": ("n_symbols", "word_chars", 1, False),
    "caps_ratio": ("n_caps", "word_chars", 1, False),
    "dup_line_ratio": ("n_dup_lines", "n_text_lines", 1, False),
    "repeat_ratio": ("n_repeat_words", "n_words", 2 * WINDOW, False),
    "word_length": ("word_chars", "n_words", 0, True),
}


def free(event: int) -> int:
    """The part of a count that is never held against a text."""
    return int(REACH * event)


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_caps, n_text_lines,
    n_dup_lines, n_repeat_words, base_failed.

    Columns used inside a lambda are referenced more than once on purpose: the
    optimizer then computes them once per row instead of once per element."""
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    bare = F.translate("__t", SPACE, "")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    d = d.select(
        *keep, F.split(F.btrim("__t", F.lit(SPACE)), r"[\x20\x09-\x0D]+").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("__l"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("__t") - F.length(F.translate("__t", upper, ""))).cast("long").alias("n_caps"))
    d = d.select(
        *keep, "__w", F.when(F.col("word_chars") == 0, 0).otherwise(F.size("__w")).cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_caps", F.size("__l").cast("long").alias("n_text_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    rest = ", ".join(f"get(__w, i + {k})" for k in range(1, WINDOW))
    windows = F.expr(f"transform(slice(__w, 1, greatest(0, size(__w) - {WINDOW - 1})), (w, i) -> xxhash64(w, {rest}))")
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_caps", "n_text_lines", "n_dup_lines"]
    d = d.select(*base, windows.alias("__h"))
    # only texts with a repeated window sort their windows
    d = d.select(*base, F.expr("if(size(array_distinct(__h)) < size(__h), "
                               "sort_array(transform(__h, (x, i) -> struct(x AS h, i AS i))), "
                               "array())").alias("__s"))
    d = d.select(*base, F.expr(
        "sort_array(transform(filter(__s, (x, i) -> get(__s, i - 1).h <=> x.h OR get(__s, i + 1).h <=> x.h), x -> x.i))"
    ).alias("__p"))
    covered = F.expr(f"aggregate(transform(__p, (x, i) -> least({WINDOW}, coalesce(get(__p, i + 1), x + {WINDOW}) - x)), "
                     "0L, (a, x) -> a + x)")
    d = d.select(*base, F.when(F.size("__p") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10)
                        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def sketches(counts: DataFrame) -> DataFrame:
    """``(level, lang, source, metric, bucket, n)``: level 2 per language and
    source, 1 per language, 0 for all; the upper levels are merged from level 2."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(n, per).alias("value")) for m, (n, per, _, _) in METRICS.items()])
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.log(F.lit(GAMMA)))).otherwise(ZERO).cast("int")
    fine = (counts.where(~F.col("base_failed")).select("lang", "source", F.inline(cells))
            .groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n")))
    return (fine.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
            .groupBy("level", F.when(F.col("level") > 0, F.col("lang")).alias("lang"),
                     F.when(F.col("level") > 1, F.col("source")).alias("source"), "metric", "bucket")
            .agg(F.sum("n").alias("n")))


def quantiles(sketch: DataFrame) -> DataFrame:
    """``(level, lang, source, metric, rows, q10, q25, q75, q90)`` of every sketch."""
    key = ["level", "lang", "source", "metric"]
    c = (sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")))
         .withColumn("all", F.sum("n").over(Window.partitionBy(*key))))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(
        F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / (GAMMA + 1))
    return c.groupBy(*key).agg(F.max("all").alias("rows"), *[
        F.min(F.when(F.col("upto") >= F.col("all") * p, value)).alias(n) for n, p in QUANTILES.items()])


def _blended(own: DataFrame, above: DataFrame, on, prior_rows: int) -> DataFrame:
    """``own`` quantiles drawn towards those ``above`` by ``prior_rows`` rows' weight."""
    j = own.alias("o").join(above.alias("a"), on)
    return j.select("o.level", "o.lang", "o.source", "o.metric", "o.rows", *[
        ((F.col("o.rows") * F.col(f"o.{q}") + F.lit(float(prior_rows)) * F.col(f"a.{q}"))
         / (F.col("o.rows") + F.lit(float(prior_rows)))).alias(q) for q in QUANTILES])


def thresholds(sketch: DataFrame, prior_rows: int = PRIOR_ROWS, reach: float = REACH) -> DataFrame:
    """``(lang, source, <metric>_low, <metric>_high ...)`` per language and source."""
    q = materialize(quantiles(sketch), "quantiles")
    same = F.col("o.metric") == F.col("a.metric")
    by_lang = _blended(q.where("level = 1"), q.where("level = 0"), same, prior_rows)
    group = _blended(q.where("level = 2"), by_lang, same & F.col("o.lang").eqNullSafe(F.col("a.lang")), prior_rows)
    spread = F.greatest(F.col("q75") - F.col("q25"), (F.col("q90") - F.col("q10")) / F.lit(TAIL))
    group = (group.withColumn("low", (F.col("q25") - F.lit(reach) * spread) / F.lit(GAMMA))
             .withColumn("high", (F.col("q75") + F.lit(reach) * spread) * F.lit(GAMMA)))
    return group.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in METRICS for s in ("low", "high")])


def verdicts(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds one boolean ``out_<metric>`` per metric: beyond the group's fences."""
    j = counts.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = {}
    for m, (n, per, event, both) in METRICS.items():
        beyond = F.try_divide(F.col(n) - F.lit(free(event)), F.col(per)) > F.col(f"{m}_high")
        if both:
            beyond = beyond | (F.try_divide(n, per) < F.col(f"{m}_low"))
        out[f"out_{m}"] = ~F.col("base_failed") & F.coalesce(beyond, F.lit(False))
    return j.withColumns(out)


def judge(counts: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``kept``: passes the base rules and lies within the group's fences."""
    beyond = F.lit(False)
    for m in METRICS:
        beyond = beyond | F.col(f"out_{m}")
    return verdicts(counts, fences).withColumn("kept", ~F.col("base_failed") & ~beyond)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Counts, ``base_failed``, ``out_<metric>`` and ``kept`` per row of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                    F.col(text_col).alias("text"))
    counts = materialize(text_counts(d), "counts")
    return judge(counts, thresholds(sketches(counts), prior_rows))
