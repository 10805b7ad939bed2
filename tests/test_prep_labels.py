from semcode.operators import labels as L
from semcode.operators import prep as P


def test_prepare_labels_string_only(spark):
    s = spark.createDataFrame([(1, "0"), (2, "x"), (3, None), (4, "Other")], "id long, Label string")
    out = {r["id"]: r["label"] for r in P.prepare_labels(s).collect()}
    assert out == {1: "Other", 2: "x", 3: None, 4: "Other"}
    assert P.other_count(P.prepare_labels(s)).first()["n_other"] == 2
    i = spark.createDataFrame([(1, 0), (2, 1)], "id long, Label int")
    assert {r["label"] for r in P.prepare_labels(i).collect()} == {0, 1}   # numeric column untouched


def test_rename_and_fill(spark):
    raw = spark.createDataFrame([("t", "s")], "tag string, sentence string")
    assert P.rename_reference(raw).columns == ["class", "matching_node"]
    t = spark.createDataFrame([(1, None), (2, "x")], "id long, sentence string")
    assert [r[0] for r in P.fill_empty_text(t).orderBy("id").select("sentence").collect()] == ["", "x"]
    assert P.drop_missing(t, ["sentence"]).count() == 1


def test_label_sets(spark):
    ref = spark.createDataFrame([(10, "b"), (11, "a"), (12, "b"), (13, None)], "ref_id long, class string")
    lab = spark.createDataFrame([(1, "a"), (2, "Other"), (3, None), (4, "c")], "doc_id long, label string")
    v = L.validate_labels(lab, ref).first()
    assert not v["is_valid"] and v["n_unknown"] == 2 and v["n_null_labels"] == 1
    assert {r[0] for r in L.unknown_labels(lab, ref).collect()} == {"Other", "c"}
    c = L.common_labels(lab, ref).first()
    assert (c["n_reference"], c["n_labeled"], c["n_common"]) == (2, 3, 1)
    idx = {r["class"]: r["class_idx"] for r in L.class_index(ref.where("class is not null")).collect()}
    assert idx == {"b": 0, "a": 1}                                  # first appearance, not frequency
    assert L.labels_are_valid(lab.where("label = 'a'"), ref)
