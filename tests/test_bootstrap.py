import pytest
from pyspark.sql import functions as F

from semcode.operators import bootstrap as B
from semcode.operators import match as M
from semcode.plans import inputs as I
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def pred(spark):
    m = M.match(I.embedding_corpus(spark, SF_MID), I.embedding_reference(spark, SF_MID))
    return M.apply_threshold(m, 0.3).cache()


def test_cells_reproducible_and_nested(pred):
    _, a = B.bootstrap(pred, n_iterations=300, seed=7)
    _, b = B.bootstrap(pred, n_iterations=300, seed=7)
    ra = sorted(tuple(r) for r in a.collect())
    assert ra == sorted(tuple(r) for r in b.collect())
    by = {(r["metric"], r["level"]): r for r in a.collect()}
    for m in ("accuracy", "f1_macro"):
        lo90, lo99 = by[(m, 0.9)]["lower"], by[(m, 0.99)]["lower"]
        hi90, hi99 = by[(m, 0.9)]["upper"], by[(m, 0.99)]["upper"]
        assert lo99 <= lo90 <= by[(m, 0.9)]["point"] + 0.05 and hi90 <= hi99


def test_cells_agree_with_rows(pred):
    _, c = B.bootstrap(pred, n_iterations=400, seed=3, levels=(0.95,), method="cells")
    _, r = B.bootstrap(pred, n_iterations=400, seed=3, levels=(0.95,), method="rows")
    cc = {x["metric"]: x for x in c.collect()}
    rr = {x["metric"]: x for x in r.collect()}
    for m in cc:
        assert abs(cc[m]["lower"] - rr[m]["lower"]) < 0.03
        assert abs(cc[m]["upper"] - rr[m]["upper"]) < 0.03
        assert cc[m]["point"] == pytest.approx(rr[m]["point"])


def test_draws_sum_to_the_rows_whatever_the_slices(spark):
    cells = spark.createDataFrame([("a", f"p{i}", i % 7 + 1) for i in range(300)] + [("b", "a", 5), ("c", "c", 0)],
                                  "true_class string, predicted_class string, n long")
    n = cells.agg(F.sum("n")).first()[0]
    drawn = B.draw_cells(cells, ["true_class", "predicted_class"], 40, 5)
    sums = {r["iteration"]: r["n"] for r in drawn.groupBy("iteration").agg(F.sum("n").alias("n")).collect()}
    assert sums == {i: n for i in range(40)}
    again = B.draw_cells(cells.repartition(7), ["true_class", "predicted_class"], 40, 5)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    mean = drawn.where("true_class = 'b'").agg(F.sum("n") / 40).first()[0]
    assert abs(mean - 5) < 2


def test_dense_index(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    idx = B.dense_index(df, "doc_id")
    got = [r["doc_id"] for r in idx.orderBy("row_idx").collect()]
    from semcode.functions.hashing import md5_u32
    want = [r["doc_id"] for r in df.orderBy(md5_u32(F.col("doc_id")), "doc_id").collect()]
    assert got == want
    assert [r[0] for r in idx.select("row_idx").orderBy("row_idx").collect()] == list(range(1000))


def test_histogram_bins(spark):
    reps = spark.createDataFrame([(i, "accuracy", float(i)) for i in range(31)] +
                                 [(i, "f1_macro", 0.5) for i in range(5)], "iteration long, metric string, value double")
    h = {(r["metric"], r["bin"]): r["n"] for r in B.histogram(reps, 30).collect()}
    assert h[("accuracy", 30)] == 2 and sum(v for (m, _), v in h.items() if m == "accuracy") == 31
    assert h[("f1_macro", 1)] == 5
