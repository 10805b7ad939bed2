import pytest
from pyspark.sql import functions as F

from semcode.functions.hashing import md5_u32, seeded_key
from semcode.operators import sampling as SA
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang", "source").cache()


def test_sizes(docs):
    n = docs.count()
    assert SA.sample(docs, "random", 37, seed=1).count() == 37
    assert SA.sample(docs, "random", 0.1, seed=1).count() == int(n * 0.1)
    assert SA.sample(docs, "random", 1, seed=1).count() == 1          # int 1 is one row
    assert SA.sample(docs, "random", 1.0, seed=1).count() == n        # float 1.0 is everything
    assert SA.sample(docs, "random", n, seed=1).count() == n


def test_errors(docs):
    for bad in (0, 0.0, 1.5, 10 ** 9):
        with pytest.raises(ValueError):
            SA.sample(docs, "random", bad)
    with pytest.raises(ValueError):
        SA.sample(docs, "stratified", 0.1)
    with pytest.raises(ValueError):
        SA.sample(docs, "stratified", 0.1, stratify_column="nope")
    with pytest.raises(ValueError):
        SA.sample(docs, "systematic", 0.1)


def test_null_stratum_raises(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, s string")
    with pytest.raises(ValueError):
        SA.sample(df, "stratified", 0.5, stratify_column="s")


def test_bucket_plan_equals_sort(docs):
    got = {r["doc_id"] for r in SA.sample(docs, "random", 123, seed=9).collect()}
    h = md5_u32(seeded_key(9, "doc_id"))
    want = {r["doc_id"] for r in docs.orderBy(h, "doc_id").limit(123).collect()}
    assert got == want


def test_stratified_quotas(docs):
    n = docs.count()
    k = int(n * 0.1)
    s = SA.sample(docs, "stratified", 0.1, stratify_column="source", seed=3)
    got = {r["source"]: r["count"] for r in s.groupBy("source").count().collect()}
    for r in docs.groupBy("source").count().collect():
        want = min(r["count"], max(1, int(k * (r["count"] / n))))
        assert got[r["source"]] == want
    assert "Label" in s.columns and s.where(F.col("Label").isNotNull()).count() == 0


def test_one_row_strata(spark):
    df = spark.createDataFrame([(i, "big") for i in range(50)] + [(100, "tiny")], "doc_id long, s string")
    s = SA.sample(df, "stratified", 0.1, stratify_column="s", seed=0)
    got = {r["s"]: r["count"] for r in s.groupBy("s").count().collect()}
    assert got == {"big": 4, "tiny": 1}     # int(5 * 50/51) = 4; max(1, int(5 * 1/51)) = 1
