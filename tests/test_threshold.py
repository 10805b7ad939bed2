import pytest
from pyspark.sql import functions as F

from semcode.operators import evaluate as E
from semcode.operators import match as M
from semcode.operators import threshold as TH
from semcode.plans import inputs as I
from tests.conftest import SF_SMALL


def test_grid_edges():
    assert TH.threshold_grid(0, 1, 0.35) == [0.0, 0.35, 0.7]          # 1.05 dropped, not raised
    g = TH.threshold_grid(0.5, 1, 0.01)
    assert len(g) == 51 and g[-1] == 1.0                               # 1.0000000000000004 -> 1
    assert TH.threshold_grid(0, 0.6, 0.35) == [0.0, 0.35, 0.7]         # overshoot below 1 kept
    assert TH.threshold_grid(0.2, 0.4, 0.01)[-1] == 0.4
    for bad in ((0.5, 0.5, 0.1), (-0.1, 0.5, 0.1), (0.2, 1.2, 0.1)):
        with pytest.raises(ValueError):
            TH.threshold_grid(*bad)


@pytest.fixture(scope="module")
def matches(spark):
    m = M.match(I.embedding_corpus(spark, SF_SMALL), I.embedding_reference(spark, SF_SMALL))
    return m.cache()


def test_one_pass_sweep_equals_naive_sweep(spark, matches):
    grid = TH.threshold_grid(0.2, 0.4, 0.02)
    curve, dist = TH.sweep(matches, 0.2, 0.4, 0.02)
    got = {r["threshold_idx"]: r for r in curve.collect()}
    n = matches.count()
    for j, t in enumerate(grid):
        naive = E.summary(E.confusion(M.apply_threshold(matches, t))).first()
        for m in E.METRICS:
            assert got[j][m] == pytest.approx(naive[m], abs=1e-12)
        total = dist.where(F.col("threshold_idx") == j).agg(F.sum("n")).first()[0]
        assert total == n


def test_optimum_is_first_max(spark):
    curve = spark.createDataFrame([(0, 0.1, 0.5, 0.5, 0.5, 0.7), (1, 0.2, 0.5, 0.5, 0.5, 0.7),
                                   (2, 0.3, 0.5, 0.5, 0.5, 0.6)],
                                  "threshold_idx int, threshold double, accuracy double, "
                                  "precision_macro double, recall_macro double, f1_macro double")
    assert TH.optimum(curve, "f1_macro").first()["threshold_idx"] == 0
    with pytest.raises(ValueError):
        TH.optimum(curve, "auc")
    oc = TH.optimization_curve(curve).where("is_optimal").select("threshold_idx").distinct().collect()
    assert [r[0] for r in oc] == [0]


def test_sweep_intervals_cells_vs_rows(spark, matches):
    a = {(r["threshold_idx"], r["metric"]): r for r in
         TH.sweep_intervals(matches, 0.2, 0.4, 0.05, n_iterations=200, seed=1, method="cells").collect()}
    b = {(r["threshold_idx"], r["metric"]): r for r in
         TH.sweep_intervals(matches, 0.2, 0.4, 0.05, n_iterations=200, seed=1, method="rows").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["lower"] <= a[k]["upper"]
        assert abs(a[k]["lower"] - b[k]["lower"]) < 0.08 and abs(a[k]["upper"] - b[k]["upper"]) < 0.08
