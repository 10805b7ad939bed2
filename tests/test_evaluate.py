import pytest

from semcode.operators import evaluate as E

ROWS = [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "Other"), (5, "c", "c")]


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(ROWS, "doc_id long, true_label string, predicted_class string")


def test_summary_by_hand(pred):
    s, per, dense = E.evaluate(pred)
    r = s.first()
    assert r["accuracy"] == pytest.approx(0.6)
    assert r["precision_macro"] == pytest.approx((1 + 0.5 + 1 + 0) / 4)    # Other counts: P = 0
    assert r["recall_macro"] == pytest.approx((0.5 + 0.5 + 1 + 0) / 4)
    assert r["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 1 + 0) / 4)
    assert r["n_samples"] == 5
    pc = {x["class"]: x for x in per.collect()}
    assert sorted(pc) == ["Other", "a", "b", "c"]
    assert pc["a"]["precision"] == 1.0 and pc["a"]["recall"] == 0.5 and pc["a"]["support"] == 2
    assert pc["Other"]["support"] == 0 and pc["Other"]["f1"] == 0.0
    assert dense.count() == 16 and sum(x["n"] for x in dense.collect()) == 5


def test_class_list_restricts_tables_not_macro(pred):
    s, per, dense = E.evaluate(pred, classes=["a", "z"])
    pc = {x["class"]: x for x in per.collect()}
    assert sorted(pc) == ["a", "z"] and pc["z"]["support"] == 0 and pc["z"]["precision"] == 0.0
    assert s.first()["precision_macro"] == pytest.approx(0.625)
    assert dense.count() == 4


def test_nulls_left_out(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, None, "a"), (3, "a", None)],
                               "doc_id long, true_label string, predicted_class string")
    assert E.evaluate(df)[0].first()["n_samples"] == 1


def test_grouped_summary_equals_single(spark, pred):
    from pyspark.sql import functions as F
    two = pred.withColumn("g", F.lit(1)).unionByName(pred.withColumn("g", F.lit(2)))
    cells = E.confusion(two, group_cols=["g"])
    rows = E.summary(cells, ["g"]).collect()
    single = E.summary(E.confusion(pred)).first()
    for r in rows:
        assert r["f1_macro"] == pytest.approx(single["f1_macro"])


def test_filters(pred):
    assert E.filter_predictions(pred, "correct").count() == 3
    assert E.filter_predictions(pred, "incorrect").count() == 2
    assert E.filter_predictions(pred, "none").count() == 0
    with pytest.raises(ValueError):
        E.filter_predictions(pred, "maybe")
