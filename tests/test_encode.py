import numpy as np
import pytest
from pyspark.sql import functions as F

from semcode.operators import encode as EN
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "The cat, the CAT and the dog."), (2, None), (3, "   "),
                                  (4, "Élan vital — élan!")], "doc_id long, text string")


def test_hashed_matches_sql_plan(texts):
    vec = {r["doc_id"]: r["embedding"] for r in EN.hashed_encode(texts, dim=16).collect()}
    long = EN.hashed_counts_long(texts, "doc_id", dim=16).collect()
    for r in long:
        assert vec[r["doc_id"]][r["bucket"]] == pytest.approx(r["value"])
    assert vec[2] == [0.0] * 16 and vec[3] == [0.0] * 16             # null / blank -> zero vector
    assert np.linalg.norm(vec[1]) == pytest.approx(1.0)
    assert sum(1 for x in vec[4] if x) >= 1                          # accented words are kept


def test_encode_with_host_and_dedupe(spark):
    df = spark.createDataFrame([(i, ["aa", "b", "aa", None][i % 4]) for i in range(40)], "doc_id long, text string")

    def factory():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    a = {r["doc_id"]: list(r["embedding"]) for r in EN.encode_with(df, "text", factory, batch_size=3).collect()}
    b = {r["doc_id"]: list(r["embedding"]) for r in EN.encode_with(df, "text", factory, dedupe=True).collect()}
    assert a == b and a[3] == [0.0, 1.0]                             # null text encoded as ""


class FakeClient:
    def __init__(self, fail_times=0, error="429 RESOURCE_EXHAUSTED", short=False):
        self.fail_times, self.error, self.short = fail_times, error, short

    def embed(self, texts):
        if self.fail_times:
            self.fail_times -= 1
            raise RuntimeError(self.error)
        out = [[float(len(t)), 1.0] for t in texts]
        return out[:-1] if self.short else out


def test_remote_retry_and_status(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    ok = EN.encode_remote(df, "doc_id", "text", lambda: FakeClient(fail_times=2), dim=2, batch_size=10,
                          sleep=lambda s: None).collect()
    assert all(r["status"] == "ok" for r in ok) and len(ok) == 5
    short = EN.encode_remote(df, "doc_id", "text", lambda: FakeClient(short=True), dim=2, batch_size=10,
                             sleep=lambda s: None).collect()
    # the vector that did not come is null; the others stay with their rows
    assert sorted((r["status"], r["embedding"] is None) for r in short) == [("missing", True)] + [("ok", False)] * 4
    assert short[0].asDict().keys() == {"doc_id", "text", "embedding", "status"}
    with pytest.raises(Exception):
        EN.encode_remote(df, "doc_id", "text", lambda: FakeClient(fail_times=1, error="boom"), dim=2,
                         sleep=lambda s: None).collect()
    with pytest.raises(Exception):
        EN.encode_remote(df, "doc_id", "text", lambda: FakeClient(fail_times=5), dim=2,
                         sleep=lambda s: None).collect()


def test_hashing_encoder_equals_the_sql_form(texts):
    a = {r["doc_id"]: r["embedding"] for r in EN.hashed_encode(texts, dim=16).collect()}
    b = {r["doc_id"]: r["embedding"] for r in
         EN.encode_with(texts, "text", lambda: EN.hashing_encoder(16), dedupe=True).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_dedupe_encodes_each_distinct_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def encode(batch):
            seen.add(len(batch))
            return np.ones((len(batch), 2))
        return encode
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(200)], "doc_id long, text string")
    assert len(EN.encode_with(df, "text", factory, dedupe=True).collect()) == 200 and seen.value == 7
    with pytest.raises(ValueError):
        EN.encode_with(df, "nope", factory)


def test_remote_over_documents(spark):
    """The remote host against an in-process client that hashes words."""
    class Client:
        def embed(self, batch):
            return EN.hashing_encoder(16)(batch).tolist()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    out = EN.encode_remote(docs, "doc_id", "text", Client, dim=16, pause_s=0.0)
    assert out.columns == ["doc_id", "text", "lang", "embedding", "status"]
    want = {r["doc_id"]: r["embedding"] for r in EN.hashed_encode(docs, dim=16).collect()}
    got = {r["doc_id"]: r["embedding"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_retry_delays():
    slept = []
    calls = {"n": 0}

    def fn():
        calls["n"] += 1
        if calls["n"] < 3:
            raise RuntimeError("429")
        return "ok"
    assert EN._with_retry(fn, 3, 2.0, slept.append) == "ok" and slept == [2.0, 4.0]


def test_mean_pool_masked(spark):
    t = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [100.0, 100.0], 0),
                               (2, 0, [5.0, 5.0], 0)], "k long, pos int, v array<double>, m int")
    out = {r["k"]: r["embedding"] for r in EN.mean_pool(t, "k", "pos", "v", "m").collect()}
    assert out[1] == pytest.approx([2.0, 3.0]) and out[2] == pytest.approx([0.0, 0.0])


def test_request_plan(spark):
    assert spark.range(1).select(EN.request_plan(F.lit(250))).first()[0] == 3
