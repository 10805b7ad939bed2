import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from semcode.operators.partitioning import spread
from semcode.plans import inputs as I
from semcode.plans.registry import positive_zero_rounding
from semcode.session import checkpoint_dir
from semcode.sources import sinks as SK
from semcode.sources import tables as ST
from semcode.streaming import classify_stream as CS
from tests.conftest import SF_SMALL


def test_positive_zero_rounding():
    sql = "SELECT round(avg(x), 6) AS a, around(1), round(round(y, 2), 9) FROM t"
    out = positive_zero_rounding(sql)
    assert out == ("SELECT (round(avg(x), 6) + 0.0) AS a, around(1), "
                   "(round((round(y, 2) + 0.0), 9) + 0.0) FROM t")


def test_spread_only_when_needed(spark):
    one = spark.range(0, 100, numPartitions=1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism + 1)
    assert spread(many, "id") is many


def test_building_a_spread_plan_runs_no_job(spark):
    from semcode.operators import topics as TP
    from semcode.plans import classify as C
    docs = I.table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    truth = I.doc_labelled(spark, SF_SMALL)
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "plans only")
    try:
        C.encode_corpus(spread(docs, "doc_id").join(truth, "doc_id"), "text")
        clusters = docs.groupBy("lang").count()
        TP.dictionary(TP.tokenize(docs.join(clusters, "lang").withColumn("cluster", F.lit(0)), "doc_id", "text"), "doc_id")
        assert list(sc.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_csv_keeps_empty_apart_from_missing(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x\ny")], "doc_id long, text string")
    path = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    SK.save_results(df, path, fmt="csv")
    assert sorted(map(tuple, SK.read_results(spark, path, df.schema, fmt="csv").collect())) == sorted(map(tuple, df.collect()))
    assert ST.null_report(ST.load_corpus(spark, path, "text", fmt="csv", null_values=()), ["text"]).first()["nulls_text"] == 1
    assert ST.null_report(ST.load_corpus(spark, path, "text", fmt="csv"), ["text"]).first()["nulls_text"] == 2


def test_csv_in_zstd_reads_back(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, 'x\n"y", z'), (4, "long " * 50_000 + "end")], "doc_id long, text string")
    path = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    SK.save_results(df, path, fmt="csv", compression="zstd")
    local = path.removeprefix("file:")
    assert sum(os.path.getsize(os.path.join(local, f)) for f in os.listdir(local)) < 5_000
    assert sorted(map(tuple, SK.read_results(spark, path, df.schema, fmt="csv").collect())) == sorted(map(tuple, df.collect()))
    assert ST.load_corpus(spark, path, "text", fmt="csv", null_values=()).count() == 4


def test_classify_holds_its_files_in_little_disk(spark, tmp_path):
    """Long references win most rows, and a result names its reference twice."""
    from semcode import session
    from semcode.plans import q_encode as Q
    rng = np.random.default_rng(0)
    words = np.array([f"{w:x}" for w in rng.integers(0, 1 << 40, 4_000)])
    texts = [" ".join(rng.choice(words, 5_000 if i % 4 == 0 else 60)) for i in range(240)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.q_classify(spark, str(tmp_path))
    base = session._SCRATCH[-1][1].removeprefix("file:")
    held = sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(base) for f in fs)
    assert got.count() == 240 and held < 2 * sum(map(len, texts))


def test_checkpoint_dir_is_read_from_session(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None


def test_csv_round_trip_and_required_columns(spark):
    df = spark.createDataFrame([(1, "a, \"quoted\"\nline", None), (2, "", "x")],
                               "doc_id long, sentence string, label string")
    path = os.path.join(checkpoint_dir(spark), f"t-{uuid.uuid4().hex}")
    SK.save_results(df, path, fmt="csv")
    back = ST.load_corpus(spark, path + "/*.csv", "sentence")
    got = {int(r["doc_id"]): r["sentence"] for r in back.collect()}
    assert got[1] == "a, \"quoted\"\nline"
    rep = ST.null_report(back, ["label"]).first()
    assert rep["n_rows"] == 2 and rep["nulls_label"] == 1
    try:
        ST.load_reference(spark, path + "/*.csv")
        raise AssertionError("missing columns must raise")
    except ValueError:
        pass


def test_stream_above_the_broadcast_budget(spark):
    from semcode.operators import match as M
    schema = I.table(spark, SF_SMALL, "embeddings").schema
    stream = (CS.file_stream(spark, SF_SMALL, schema, glob="embeddings.parquet")
              .where(~I.is_reference("vec_id")).select(F.col("vec_id").alias("doc_id"), "embedding"))
    ref = I.embedding_reference(spark, SF_SMALL)
    base = os.path.join(checkpoint_dir(spark), f"s-{uuid.uuid4().hex}")
    out = M.match(stream, ref, max_broadcast_bytes=0, block_bytes=4096)
    CS.run_available(out.select("doc_id", "best_ref_id", "best_class"), base + "/out", base + "/state")
    want = M.match(I.embedding_corpus(spark, SF_SMALL), ref).select("doc_id", "best_ref_id", "best_class")
    got = spark.read.parquet(base + "/out")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_stream_in_blocks_and_a_batch_run_again(spark):
    from semcode.operators import match as M
    schema = I.table(spark, SF_SMALL, "embeddings").schema
    stream = (CS.file_stream(spark, SF_SMALL, schema, glob="embeddings.parquet")
              .where(~I.is_reference("vec_id")).select(F.col("vec_id").alias("doc_id"), "embedding"))
    ref = I.embedding_reference(spark, SF_SMALL)
    base = os.path.join(checkpoint_dir(spark), f"s-{uuid.uuid4().hex}")
    want = M.apply_threshold(M.match(I.embedding_corpus(spark, SF_SMALL), ref), 0.3).select("doc_id", "predicted_class", "matched_node")
    for state in ("/state", "/state", "/lost"):  # the last run has lost its progress: its batch replaces the first
        CS.classify_batches(stream, ref, 0.3, base + "/out", base + state, max_broadcast_bytes=0, block_bytes=4096,
                            columns=["doc_id", "predicted_class", "matched_node"])
        got = spark.read.parquet(base + "/out").drop("batch")
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_stream_equals_batch(spark):
    schema = I.table(spark, SF_SMALL, "embeddings").schema
    stream = (CS.file_stream(spark, SF_SMALL, schema, glob="embeddings.parquet")
              .where(~I.is_reference("vec_id")).select(F.col("vec_id").alias("doc_id"), "embedding"))
    out = CS.classify_stream(stream, I.embedding_reference(spark, SF_SMALL), 0.3)
    base = os.path.join(checkpoint_dir(spark), f"s-{uuid.uuid4().hex}")
    CS.run_available(out.select("doc_id", "predicted_class"), base + "/out", base + "/state")
    got = spark.read.parquet(base + "/out")
    from semcode.operators import match as M
    want = M.apply_threshold(M.match(I.embedding_corpus(spark, SF_SMALL), I.embedding_reference(spark, SF_SMALL)),
                             0.3).select("doc_id", "predicted_class")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_stream_queries_read_a_folder_of_part_files(spark, tmp_path):
    """A table may be a folder of part files, one file, or hold no row."""
    import pyarrow.parquet as pq

    from semcode.plans.catalog import QUERIES
    e = I.table(spark, SF_SMALL, "embeddings")
    for name, rows, parts in (("parts", e, 3), ("empty", e.where(I.is_reference("vec_id")), 1), ("file", e, 0)):
        d = str(tmp_path / name)
        if parts:
            rows.repartition(parts).write.parquet(f"{d}/embeddings.parquet")
        else:
            os.makedirs(d)
            pq.write_table(rows.toArrow(), f"{d}/embeddings.parquet")
        want = {r.vec_id for r in rows.where(~I.is_reference("vec_id")).collect()}
        for q in ("stream_classify", "stream_classify_batches"):
            got = QUERIES[q](spark, d).collect()
            assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert CS.output(spark, str(tmp_path / "none"), "doc_id long").count() == 0
