"""Queries: evaluation, bootstrap and threshold sweep of the embedding corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from semcode.functions.hashing import md5_u32, seeded_key
from semcode.operators import bootstrap as B
from semcode.operators import evaluate as E
from semcode.operators import threshold as TH
from semcode.plans import inputs as I
from semcode.plans import sqlgen as S
from semcode.plans.q_match import PRED_SQL, best_matches, thresholded
from semcode.plans.registry import register, r6, r9

N_BOOT = 1000   # the library's default
N_SWEEP = 100
N_GROUPS = 50   # groups of rows left out in turn by the jackknife
N_BINS = 30
LEVELS = (0.9, 0.95, 0.99)
START, END, STEP = I.GRID
GRID = TH.threshold_grid(START, END, STEP)
M_GRID = len(GRID)

CELLS_SQL = f"""{I.EMB_SQL}, {PRED_SQL},
cells AS (SELECT true_label AS true_class, predicted_class, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY 1, 2),
{S.metric_ctes('cells')}"""


def cells(spark, sf_dir):
    return E.confusion(thresholded(spark, sf_dir))


def _r6_all(df, skip=()):
    return df.select(*[r6(c).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


# ------------------------------------------------------------- evaluation
@register("confusion_long", f"WITH {CELLS_SQL} SELECT true_class, predicted_class, n FROM cells")
def q_confusion_long(spark, sf_dir):
    return cells(spark, sf_dir)


@register("confusion_dense", f"""WITH {CELLS_SQL},
cls AS (SELECT true_class AS c FROM cells UNION SELECT predicted_class FROM cells)
SELECT a.c AS true_class, b.c AS predicted_class, CAST(coalesce(cells.n, 0) AS BIGINT) AS n
FROM cls a JOIN cls b ON true LEFT JOIN cells ON cells.true_class = a.c AND cells.predicted_class = b.c""")
def q_confusion_dense(spark, sf_dir):
    return E.confusion_dense(cells(spark, sf_dir))


@register("accuracy", f"WITH {CELLS_SQL} SELECT round(accuracy, 6) AS accuracy, n_samples FROM m_acc")
def q_accuracy(spark, sf_dir):
    s = E.summary(cells(spark, sf_dir))
    return s.select(r6("accuracy").alias("accuracy"), "n_samples")


@register("per_class_metrics", f"""WITH {CELLS_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m_pc""")
def q_per_class(spark, sf_dir):
    return _r6_all(E.per_class(cells(spark, sf_dir)))


@register("macro_metrics", f"""WITH {CELLS_SQL}
SELECT round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
       round(f1_macro, 6) AS f1_macro FROM m_mac""")
def q_macro(spark, sf_dir):
    s = E.summary(cells(spark, sf_dir))
    return _r6_all(s.select("precision_macro", "recall_macro", "f1_macro"))


@register("evaluate", f"""WITH {CELLS_SQL}
SELECT round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro,
       round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro, n_samples FROM m_sum""")
def q_evaluate(spark, sf_dir):
    return _r6_all(E.summary(cells(spark, sf_dir)))


@register("label_union", f"""WITH {CELLS_SQL}
SELECT true_class AS class FROM cells UNION SELECT predicted_class FROM cells""")
def q_label_union(spark, sf_dir):
    return E.label_union(cells(spark, sf_dir))


@register("mark_correct", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class, predicted_class IS NOT DISTINCT FROM true_label AS correct FROM pred""")
def q_mark_correct(spark, sf_dir):
    return E.mark_correct(thresholded(spark, sf_dir)).select("doc_id", "true_label", "predicted_class", "correct")


@register("filter_predictions", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class FROM pred WHERE predicted_class IS DISTINCT FROM true_label""")
def q_filter_predictions(spark, sf_dir):
    return E.filter_predictions(thresholded(spark, sf_dir), "incorrect").select(
        "doc_id", "true_label", "predicted_class")


_H20 = S.md5_u32("'42:' || CAST(doc_id AS VARCHAR)")


@register("sample_predictions", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class, round(similarity_score, 9) AS similarity_score,
       predicted_class IS NOT DISTINCT FROM true_label AS correct
FROM pred ORDER BY {_H20}, doc_id LIMIT 20""")
def q_sample_predictions(spark, sf_dir):
    """Twenty random predictions for a look by eye (the limit is the feature)."""
    df = E.mark_correct(thresholded(spark, sf_dir))
    h = md5_u32(seeded_key(42, "doc_id"))
    return (df.orderBy(h, "doc_id").limit(20)
            .select("doc_id", "true_label", "predicted_class", r9("similarity_score").alias("similarity_score"),
                    "correct"))


# -------------------------------------------------------------- bootstrap
# Draws are random, so the queries return what must hold of every replicate and
# interval beside the exact point estimates; tests compare the draws with the
# literal resampling of rows.
def _boot(spark, sf_dir):
    return B.bootstrap(thresholded(spark, sf_dir), n_iterations=N_BOOT, levels=LEVELS, seed=42)


_METRICS_SQL = f"pt AS ({S.long_metrics('m_sum')})"


@register("bootstrap_replicates", f"""WITH {CELLS_SQL}, {_METRICS_SQL}
SELECT CAST(i AS BIGINT) AS iteration, metric, TRUE AS in_range, (SELECT n_samples FROM m_acc) AS n_drawn
FROM range({N_BOOT}) t(i), pt""")
def q_boot_reps(spark, sf_dir):
    """1,000 replicates: every one draws as many rows as there are."""
    cells_ = cells(spark, sf_dir).checkpoint(eager=True)
    drawn = B.draw_cells(cells_, ["true_class", "predicted_class"], N_BOOT, 42)
    s = E.summary(drawn, ["iteration"])
    long = B.long_metrics(s, ["iteration", "n_samples"])
    return long.select("iteration", "metric", F.col("value").between(0, 1).alias("in_range"), F.col("n_samples").alias("n_drawn"))


_LEVEL_SQL = " UNION ALL ".join(f"SELECT CAST({lv!r} AS DOUBLE) AS level" for lv in LEVELS)


@register("bootstrap_intervals", f"""WITH {CELLS_SQL}, {_METRICS_SQL}, lv AS ({_LEVEL_SQL})
SELECT metric, level, round(value, 6) AS point, TRUE AS bounds_nested, TRUE AS width_as_expected FROM pt, lv""")
def q_boot_intervals(spark, sf_dir):
    """Intervals of the four metrics; the accuracy's width is compared with the
    normal approximation of its binomial (within a third)."""
    _, iv = _boot(spark, sf_dir)
    n = E.summary(cells(spark, sf_dir)).select("n_samples")
    z = F.element_at(F.create_map(*[F.lit(x) for pair in zip(LEVELS, (1.645, 1.960, 2.576)) for x in pair]), F.col("level"))
    want = 2 * z * F.sqrt(F.col("point") * (1 - F.col("point")) / F.col("n_samples"))
    width = (F.col("metric") != "accuracy") | (F.abs(F.col("upper") - F.col("lower") - want) <= want / 3 + 1e-9)
    out = (iv.join(B.bounds_nested(iv), "metric").withColumn("_g", F.lit(0)).join(n.withColumn("_g", F.lit(0)), "_g"))
    return out.select("metric", "level", r6("point").alias("point"), "bounds_nested", width.alias("width_as_expected"))


@register("bootstrap_histogram", f"""WITH {CELLS_SQL}, {_METRICS_SQL}
SELECT metric, CAST({N_BOOT} AS BIGINT) AS n, TRUE AS bins_fit FROM pt""")
def q_boot_hist(spark, sf_dir):
    """30 bins per metric: they hold all replicates and touch one another."""
    h = B.histogram(_boot(spark, sf_dir)[0], 30)
    fit = (F.col("bin").between(1, 30)) & (F.col("bin_lower") <= F.col("bin_upper"))
    return h.groupBy("metric").agg(F.sum("n").alias("n"), F.min(fit).alias("bins_fit"))


@register("jackknife_histogram", f"""WITH {I.EMB_SQL}, {PRED_SQL},
per AS (SELECT doc_id % {N_GROUPS} AS g, count(*) FILTER (WHERE true_label = predicted_class) AS c, count(*) AS n FROM pred GROUP BY 1),
reps AS (SELECT ((sum(c) OVER ()) - c)::DOUBLE / ((sum(n) OVER ()) - n)::DOUBLE AS value FROM per),
rng AS (SELECT min(value) AS lo, max(value) AS hi FROM reps),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((value - lo) / (hi - lo) * {N_BINS}) + 1, {N_BINS}) END AS INTEGER) AS bin, lo, hi
      FROM reps, rng)
SELECT 'accuracy' AS metric, bin, round(lo + (bin - 1) * (hi - lo) / {N_BINS}, 9) AS bin_lower, round(lo + bin * (hi - lo) / {N_BINS}, 9) AS bin_upper,
       count(*) AS n FROM b GROUP BY bin, lo, hi""")
def q_jackknife_hist(spark, sf_dir):
    """Bins of the accuracy when one of 50 groups of rows is left out in turn: a
    replicate table that is the same for every engine."""
    p = thresholded(spark, sf_dir).select((F.col("doc_id") % N_GROUPS).alias("g"), (F.col("true_label") == F.col("predicted_class")).alias("hit"))
    per = p.groupBy("g").agg(F.count_if("hit").alias("c"), F.count(F.lit(1)).alias("n")).withColumn("_g", F.lit(0))
    whole = per.groupBy("_g").agg(F.sum("c").alias("all_c"), F.sum("n").alias("all_n"))
    reps = per.join(whole, "_g").select(F.lit("accuracy").alias("metric"),
                                        F.try_divide(F.col("all_c") - F.col("c"), F.col("all_n") - F.col("n")).alias("value"))
    return B.histogram(reps, N_BINS).select("metric", "bin", r9("bin_lower").alias("bin_lower"), r9("bin_upper").alias("bin_upper"), "n")


@register("bootstrap_cells_intervals", f"""WITH {CELLS_SQL}, {_METRICS_SQL}, lv AS ({_LEVEL_SQL})
SELECT metric, level, round(value, 6) AS point, TRUE AS holds_point FROM pt, lv""")
def q_boot_cells(spark, sf_dir):
    """Does the interval hold the point estimate (widened by one point, as macro
    averages of replicates are biased for rare classes)?"""
    _, iv = _boot(spark, sf_dir)
    return iv.select("metric", "level", r6("point").alias("point"),
                     F.col("point").between(F.col("lower") - 0.01, F.col("upper") + 0.01).alias("holds_point"))


# ------------------------------------------------------------------ sweep
_GRID_SQL = " UNION ALL ".join(f"SELECT {i} AS threshold_idx, CAST({t!r} AS DOUBLE) AS threshold" for i, t in enumerate(GRID))
_PTS = "[" + ", ".join(repr(float(t)) for t in GRID) + "]"
SWEEP_SQL = f"""{I.EMB_SQL},
grid AS ({_GRID_SQL}),
bk AS (SELECT doc_id, true_label AS true_class, best_class,
              CAST(len(list_filter({_PTS}, lambda t: t <= similarity_score)) AS INTEGER) AS bucket FROM best),
scells AS (SELECT true_class, best_class, bucket, count(*) AS n FROM bk GROUP BY ALL),
tcells AS (SELECT g.threshold_idx, s.true_class,
                  CASE WHEN s.bucket > g.threshold_idx THEN s.best_class ELSE 'Other' END AS predicted_class,
                  CAST(sum(s.n) AS BIGINT) AS n
           FROM scells s JOIN grid g ON true GROUP BY ALL),
{S.metric_ctes('tcells', ['threshold_idx'], 's')},
curve AS (SELECT threshold_idx, threshold, accuracy, precision_macro, recall_macro, f1_macro
          FROM s_sum JOIN grid USING (threshold_idx))"""


def _curve(spark, sf_dir):
    return TH.sweep(best_matches(spark, sf_dir), START, END, STEP)


@register("threshold_grid", f"""WITH {SWEEP_SQL}
SELECT threshold_idx, round(threshold, 6) AS threshold,
       CAST((SELECT count(*) FROM best WHERE similarity_score >= threshold) AS BIGINT) AS n_at_or_above FROM grid""")
def q_grid(spark, sf_dir):
    """The grid with the number of texts that reach each point."""
    m = best_matches(spark, sf_dir)
    counts = TH.bucketed(m, GRID).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    grid = TH.grid_frame(spark, GRID)
    out = grid.join(counts, F.col("bucket") > F.col("threshold_idx"), "left").groupBy("threshold_idx", "threshold").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_at_or_above"))
    return _r6_all(out)


_CURVE_COLS = ("threshold_idx, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, "
               "round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro, "
               "round(f1_macro, 6) AS f1_macro")


@register("threshold_sweep", f"WITH {SWEEP_SQL} SELECT {_CURVE_COLS} FROM curve")
def q_sweep(spark, sf_dir):
    return _r6_all(_curve(spark, sf_dir)[0])


@register("sweep_class_distribution", f"""WITH {SWEEP_SQL}
SELECT threshold_idx, predicted_class AS class, CAST(sum(n) AS BIGINT) AS n FROM tcells GROUP BY ALL""")
def q_sweep_dist(spark, sf_dir):
    return _curve(spark, sf_dir)[1]


@register("optimal_threshold", f"""WITH {SWEEP_SQL}
SELECT {_CURVE_COLS}, 'f1_macro' AS optimized_metric FROM curve ORDER BY round(f1_macro, 9) DESC, threshold_idx LIMIT 1""")
def q_optimum(spark, sf_dir):
    return _r6_all(TH.optimum(_curve(spark, sf_dir)[0], "f1_macro"))


@register("optimization_curve", f"""WITH {SWEEP_SQL},
best_t AS (SELECT threshold_idx AS b FROM curve ORDER BY round(f1_macro, 9) DESC, threshold_idx LIMIT 1),
long AS (SELECT threshold_idx, threshold, 'accuracy' AS metric, accuracy AS value FROM curve
  UNION ALL SELECT threshold_idx, threshold, 'precision_macro', precision_macro FROM curve
  UNION ALL SELECT threshold_idx, threshold, 'recall_macro', recall_macro FROM curve
  UNION ALL SELECT threshold_idx, threshold, 'f1_macro', f1_macro FROM curve)
SELECT threshold_idx, round(threshold, 6) AS threshold, threshold_idx = (SELECT b FROM best_t) AS is_optimal,
       metric, round(value, 6) AS value FROM long""")
def q_opt_curve(spark, sf_dir):
    return _r6_all(TH.optimization_curve(_curve(spark, sf_dir)[0], "f1_macro"))


@register("top_class_curves", f"""WITH {SWEEP_SQL},
dist AS (SELECT threshold_idx, predicted_class AS class, sum(n) AS n FROM tcells GROUP BY ALL),
top AS (SELECT class FROM dist GROUP BY class ORDER BY sum(n) DESC, class LIMIT 10)
SELECT g.threshold_idx, top.class, CAST(coalesce(d.n, 0) AS BIGINT) AS n
FROM top JOIN grid g ON true LEFT JOIN dist d ON d.class = top.class AND d.threshold_idx = g.threshold_idx""")
def q_top_curves(spark, sf_dir):
    return TH.top_class_curves(_curve(spark, sf_dir)[1], M_GRID, 10)


_SWEEP_LONG = f"sl AS ({S.long_metrics('curve', ['threshold_idx', 'threshold'])})"


def _sweep_points(curve):
    return B.long_metrics(curve, ["threshold_idx", "threshold"]).withColumnRenamed("value", "point")


@register("sweep_intervals", f"""WITH {SWEEP_SQL}, {_SWEEP_LONG}
SELECT threshold_idx, metric, CAST(0.95 AS DOUBLE) AS level, round(value, 6) AS point, TRUE AS ordered, TRUE AS near_point FROM sl""")
def q_sweep_intervals(spark, sf_dir):
    """Intervals of all thresholds from shared draws over the sweep's cells."""
    cells_ = TH.sweep_cells(best_matches(spark, sf_dir), GRID).checkpoint(eager=True)
    iv = TH.sweep_intervals(None, START, END, STEP, n_iterations=N_SWEEP, level=0.95, seed=42, cells=cells_)
    curve = E.summary(TH.expand(cells_, M_GRID), ["threshold_idx"]).withColumn("threshold", F.lit(0.0))
    out = iv.join(_sweep_points(curve), ["threshold_idx", "metric"])
    near = F.col("point").between(F.col("lower") - 0.05, F.col("upper") + 0.05)
    return out.select("threshold_idx", "metric", "level", r6("point").alias("point"),
                      (F.col("lower") <= F.col("upper")).alias("ordered"), near.alias("near_point"))


@register("sweep_cells_intervals", f"""WITH {SWEEP_SQL}
SELECT CAST(i AS BIGINT) AS iteration, CAST((SELECT sum(n) FROM scells) AS BIGINT) AS n_drawn FROM range({N_SWEEP}) t(i)""")
def q_sweep_cells_intervals(spark, sf_dir):
    """The draws behind the sweep's intervals: each draws all rows once."""
    cells_ = TH.sweep_cells(best_matches(spark, sf_dir), GRID).checkpoint(eager=True)
    return B.draw_cells(cells_, TH.CELL_COLS, N_SWEEP, 42).groupBy("iteration").agg(F.sum("n").alias("n_drawn"))


@register("optimal_threshold_intervals", f"""WITH {SWEEP_SQL}, {_SWEEP_LONG},
best_t AS (SELECT threshold_idx FROM curve ORDER BY round(f1_macro, 9) DESC, threshold_idx LIMIT 1)
SELECT threshold_idx, round(threshold, 6) AS threshold, metric, CAST(0.95 AS DOUBLE) AS level, round(value, 6) AS point,
       TRUE AS ordered FROM sl JOIN best_t USING (threshold_idx)""")
def q_optimal_intervals(spark, sf_dir):
    """Intervals of the four metrics at the optimal threshold: one match, and
    only the optimum's cells are drawn and scored."""
    cells_ = TH.sweep_cells(best_matches(spark, sf_dir), GRID).checkpoint(eager=True)
    curve = E.summary(TH.expand(cells_, M_GRID), ["threshold_idx"]).join(
        F.broadcast(TH.grid_frame(spark, GRID)), "threshold_idx")  # the grid has M_GRID rows
    best = TH.optimum(curve, "f1_macro").first()
    iv = TH.sweep_intervals(None, START, END, STEP, n_iterations=N_SWEEP, level=0.95, seed=42,
                            cells=cells_, at=best["threshold_idx"])
    point = _sweep_points(curve.select("threshold_idx", "threshold", *E.METRICS))
    out = iv.join(point, ["threshold_idx", "metric"])
    return out.select(F.col("threshold_idx").cast("int").alias("threshold_idx"), r6("threshold").alias("threshold"), "metric", "level",
                      r6("point").alias("point"), (F.col("lower") <= F.col("upper")).alias("ordered"))


@register("confusion_wide", f"""WITH {CELLS_SQL},
cls AS (SELECT true_class AS c FROM cells UNION SELECT predicted_class FROM cells)
SELECT a.c AS true_class, list(coalesce(cells.n, 0)::BIGINT ORDER BY b.c) AS counts
FROM cls a JOIN cls b ON true LEFT JOIN cells ON cells.true_class = a.c AND cells.predicted_class = b.c GROUP BY a.c""")
def q_confusion_wide(spark, sf_dir):
    """Display form: one row per true class, counts in class order."""
    return E.confusion_rows(E.confusion_dense(cells(spark, sf_dir)))


@register("filter_predictions_correct", f"""WITH {I.EMB_SQL}, {PRED_SQL}
SELECT doc_id, true_label, predicted_class FROM pred WHERE predicted_class IS NOT DISTINCT FROM true_label""")
def q_filter_correct(spark, sf_dir):
    return E.filter_predictions(thresholded(spark, sf_dir), "correct").select("doc_id", "true_label", "predicted_class")


_GIVEN = ("0", "1", "2", "no such class")


@register("evaluate_given_classes", f"""WITH {CELLS_SQL}, given AS (SELECT unnest({list(_GIVEN)}) AS class)
SELECT class, round(coalesce(precision, 0.0), 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall, round(coalesce(f1, 0.0), 6) AS f1,
       CAST(coalesce(support, 0) AS BIGINT) AS support FROM given LEFT JOIN m_pc USING (class)""")
def q_given_classes(spark, sf_dir):
    """A given class list: exactly these rows, zeros for absent ones."""
    return _r6_all(E.evaluate(thresholded(spark, sf_dir), classes=_GIVEN)[1])
