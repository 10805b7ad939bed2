import numpy as np
import pytest
from pyspark.sql import functions as F

from semcode.operators import match as M
from semcode.plans import inputs as I
from tests.conftest import SF_SMALL

REF_SCHEMA = "ref_id long, class string, node string, embedding array<double>"
DOC_SCHEMA = "doc_id long, embedding array<double>"


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame([
        (5, "A", "a5", [1.0, 0.0, 0.0]),
        (3, "B", "b3", [1.0, 0.0, 0.0]),      # exact tie with ref 5: lowest ref_id wins
        (7, "C", "c7", [0.0, 1.0, 0.0]),
        (9, "Other", "o9", [0.0, 0.0, 1.0]),  # a reference class literally named Other
    ], REF_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, [2.0, 0.0, 0.0]),      # tie between ref 3 and 5 -> ref 3 / B, score 1
        (2, [0.0, 0.0, 0.0]),      # zero vector -> score 0, first reference
        (3, None),                 # missing vector -> nulls
        (4, [-1.0, -1.0, -1.0]),   # every similarity negative
        (5, [0.6, 0.8, 0.0]),      # best C with 0.8 exactly
    ], DOC_SCHEMA)


def _rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("budget", [M.DEFAULT_BROADCAST_BYTES, 0])
def test_best_match_rules(spark, ref, docs, budget):
    out = _rows(M.match(docs, ref, max_broadcast_bytes=budget))
    assert out[1]["best_ref_id"] == 3 and out[1]["best_class"] == "B"
    assert out[1]["similarity_score"] == pytest.approx(1.0)
    assert out[2]["best_ref_id"] == 3 and out[2]["similarity_score"] == 0.0
    assert out[3]["best_ref_id"] is None and out[3]["similarity_score"] is None
    assert out[4]["similarity_score"] < 0
    assert out[5]["best_class"] == "C" and out[5]["similarity_score"] == pytest.approx(0.8)


def test_threshold_rules(spark, ref, docs):
    m = M.match(docs, ref)
    at = _rows(M.apply_threshold(m, 0.8))
    assert at[5]["predicted_class"] == "C" and at[5]["matched_node"] == "c7"   # score == threshold matches
    above = _rows(M.apply_threshold(m, 0.81))
    assert above[5]["predicted_class"] == "Other" and above[5]["matched_node"] == ""
    assert above[5]["similarity_score"] == pytest.approx(0.8)                  # score kept
    zero = _rows(M.apply_threshold(m, 0.0))
    assert zero[4]["predicted_class"] == "Other"                               # negative best stays Other
    assert zero[2]["predicted_class"] == "B"                                   # 0 >= 0
    assert zero[3]["predicted_class"] is None


def test_threshold_range(spark, ref, docs):
    m = M.match(docs, ref)
    for bad in (-0.01, 1.01):
        with pytest.raises(ValueError):
            M.apply_threshold(m, bad)


@pytest.mark.parametrize("budget", [M.DEFAULT_BROADCAST_BYTES, 0])
def test_repeated_and_missing_keys_and_vectors(spark, budget):
    ref = spark.createDataFrame([(1, "A", "a", [1.0, 0.0]), (2, "B", "b", [0.0, 1.0]), (3, "C", "c", None),
                                 (1, "A2", "a2", [1.0, 0.0])], REF_SCHEMA)
    corpus = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.5, 1.0]), (None, [0.0, 1.0]), (None, None)], DOC_SCHEMA)
    m = M.match(corpus, ref, max_broadcast_bytes=budget, block_bytes=16)
    got = sorted(((r.doc_id, r.best_ref_id, r.similarity_score and round(r.similarity_score, 3)) for r in m.collect()), key=str)
    assert got == sorted([(7, 1, 1.0), (7, 2, 0.894), (None, 2, 1.0), (None, None, None)], key=str)
    assert M.reference_report(ref).first().asDict() == {"n_reference": 4, "n_without_vector": 1}


def test_empty_reference(spark, docs):
    with pytest.raises(ValueError):
        M.match(docs, spark.createDataFrame([], REF_SCHEMA))


def test_keep_all_in_ref_order(spark, ref, docs):
    m = _rows(M.match(docs, ref, keep_all=True))
    assert m[5]["all_similarities"] == pytest.approx([0.6, 0.6, 0.8, 0.0])  # ref_id 3, 5, 7, 9


def test_keep_all_by_blocks(spark, ref, docs):
    a, b = (_rows(M.match(docs, ref, keep_all=True, max_broadcast_bytes=x, block_bytes=y))
            for x, y in ((M.DEFAULT_BROADCAST_BYTES, M.DEFAULT_BLOCK_BYTES), (0, 24)))
    assert a == b and b[3]["all_similarities"] is None and len(b[4]["all_similarities"]) == 4
    ref2 = spark.createDataFrame([(4, "A", "a", [1.0, 0.0]), (4, "B", "b", [0.0, 1.0]), (None, "N", "n", [1.0, 1.0])], REF_SCHEMA)
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (None, [0.0, 0.0])], DOC_SCHEMA)
    a, b = (sorted(map(str, M.match(corpus, ref2, keep_all=True, max_broadcast_bytes=x, block_bytes=16).select(
        "doc_id", "embedding", "all_similarities").collect())) for x in (M.DEFAULT_BROADCAST_BYTES, 0))
    assert a == b


def test_salted_names(spark):
    ref = spark.createDataFrame([(1, "A", None, [1.0, 0.0]), (2, None, "b", [0.0, 1.0])], REF_SCHEMA)
    corpus = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.array(F.lit(1.0), F.when(F.col("id") % 4 == 3, 2.0).otherwise(0.0)))
                                     .alias("embedding"))
    rows = [sorted(map(str, M.match(corpus, ref, max_broadcast_bytes=x).collect())) for x in (M.DEFAULT_BROADCAST_BYTES, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 400


def test_blocked_plan_equals_broadcast_plan(spark):
    corpus, reference = I.embedding_corpus(spark, SF_SMALL), I.embedding_reference(spark, SF_SMALL)
    a = M.match(corpus, reference).select("doc_id", "best_ref_id", F.round("similarity_score", 9).alias("s"))
    b = M.match(corpus, reference, max_broadcast_bytes=0, block_bytes=4096).select(
        "doc_id", "best_ref_id", F.round("similarity_score", 9).alias("s"))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_class_distribution_and_rate(spark):
    m = M.match(I.embedding_corpus(spark, SF_SMALL), I.embedding_reference(spark, SF_SMALL))
    rates = [M.match_rate(m, t).first()["n_matched"] for t in (0.1, 0.2, 0.3, 0.4)]
    assert rates == sorted(rates, reverse=True)
    dist = M.class_distribution(M.apply_threshold(m, 0.3), top=None)
    assert dist.agg(F.sum("n")).first()[0] == m.count()


def _numbered_inputs(spark, corpus, reference):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(corpus)], "__id long, __vec array<double>")
    ref = spark.createDataFrame([(i, v) for i, v in enumerate(reference)], "ref_id long, embedding array<double>").withColumns(
        {"class": F.lit("c"), "node": F.lit("n")})
    return rows, M._numbered(ref, "ref_id", "class", "node", "embedding")


@pytest.mark.parametrize("block_bytes", [64, 4096, M.DEFAULT_BLOCK_BYTES])
def test_tree_search_is_exact_and_skips_clusters(spark, block_bytes):
    rng = np.random.default_rng(11)
    spots = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    draw = lambda n, hot: spots[np.where(rng.random(n) < hot, 0, rng.integers(0, 8, n))] + rng.normal(0, 0.05, (n, 8))
    reference = np.concatenate([draw(240, 0.4), np.zeros((3, 8))])
    reference[50:60] = reference[40:50]                                  # ties: the lower id wins
    corpus = np.concatenate([draw(200, 0.4), np.zeros((2, 8)), -spots[:1], reference[50:53] * 7])
    rows, ref = _numbered_inputs(spark, [*corpus.tolist(), None], reference.tolist())
    got = {r["__id"]: r for r in M.tree_search(rows, ref, len(reference), 8, block_bytes)
           .join(ref.select("__row", "best_ref_id"), "__row").collect()}
    j, score = M._best(corpus, reference, 1000)
    assert len(got) == len(corpus)
    for i in range(len(corpus)):
        assert (got[i]["best_ref_id"], got[i]["similarity_score"]) == (j[i], score[i])
    assert sum(r["cells"] for r in got.values()) < 0.5 * len(corpus) * len(reference)


def test_tree_search_of_zero_references_and_no_rows(spark):
    rows, ref = _numbered_inputs(spark, [[1.0, 2.0], [0.0, 0.0], None], [[0.0, 0.0]] * 5)
    got = M.tree_search(rows, ref, 5, 2, 16).join(ref, "__row").select("__id", "best_ref_id", "similarity_score").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0.0), (1, 0, 0.0)]
    assert M.tree_search(rows.where("__id > 1"), ref, 5, 2, 16).count() == 0


@pytest.mark.parametrize("threshold, block_bytes", [(0.9, 256), (0.3, 1 << 20), (0.0, 512)])
def test_similar_pairs_equal_all_pairs(spark, threshold, block_bytes):
    rng = np.random.default_rng(2)
    reference = np.concatenate([rng.normal(size=(60, 4)), np.zeros((2, 4))])
    corpus = np.concatenate([rng.normal(size=(50, 4)), np.zeros((1, 4)), reference[:3]])
    rows = spark.createDataFrame([(i % 40, v) for i, v in enumerate([*corpus.tolist(), None])], "doc_id long, embedding array<double>")
    ref = spark.createDataFrame([(i, f"c{i % 3}", v) for i, v in enumerate([*reference.tolist(), None])],
                                "ref_id long, class string, embedding array<double>")
    sim = M._similarities(corpus, reference, np.sqrt((reference ** 2).sum(1)))
    want = sorted((i % 40, j, f"c{j % 3}", sim[i, j]) for i, j in zip(*np.nonzero(sim >= threshold)))
    assert sorted(map(tuple, M.similar_pairs(rows, ref, threshold, block_bytes=block_bytes).collect())) == want


def test_similar_pairs_of_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<double>")
    ref = spark.createDataFrame([(1, "c", None)], "ref_id long, class string, embedding array<double>")
    assert M.similar_pairs(rows, ref, 0.5).count() == 0
    assert M.similar_pairs(rows.where("doc_id > 1"), ref.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), 0.5).count() == 0


def test_search_holds_small_tiles_and_narrow_references(spark, monkeypatch):
    """A worker holds one tile of similarities at a time, and single precision of a
    reference that it holds exactly."""
    rng, sizes, whole = np.random.default_rng(3), [], M._similarities
    x, ref = rng.normal(size=(700, 8)), rng.normal(size=(2500, 8)).astype(np.float32)
    ref[1200] = ref[5]
    x[9] = ref[5]
    monkeypatch.setattr(M, "_similarities", lambda a, b, n: sizes.append((len(a) * len(b), b.dtype)) or whole(a, b, n))
    j, s = M._best(x, ref, 64 << 20)
    assert max(n * 8 for n, _ in sizes) <= M.TILE_BYTES and {d for _, d in sizes} == {np.dtype(float)} and len(sizes) > 1
    every = whole(x, ref.astype(float), np.sqrt((ref.astype(float) ** 2).sum(1)))
    assert (j == every.argmax(1)).all() and (s == every.max(1)).all() and j[9] == 5
    rows = [(i, "c", "n", v) for i, v in enumerate(ref[:40].tolist())]
    kind = "ref_id long, class string, node string, embedding array<{}>"
    for vectors, held in (("float", np.float32), ("double", np.float32)):
        table = M._numbered(spark.createDataFrame(rows, kind.format(vectors)), "ref_id", "class", "node", "embedding")
        assert [bc.value[1].dtype for bc in M._broadcast_slices(table, 8, 64 << 20)] == [held]
    third = M._numbered(spark.createDataFrame([(1, "c", "n", [1 / 3] * 8)], kind.format("double")), "ref_id", "class", "node", "embedding")
    assert M._broadcast_slices(third, 8, 64 << 20)[0].value[1].dtype == np.float64
