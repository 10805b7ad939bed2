"""Entropy balancing: targets, rates, rounding."""

import math

from pyspark.sql import functions as F

from semcode.llm import mixing as M
from tests.conftest import SF_MID


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The resharing loop of the contract."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = [s for s in open_ if unit * w[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * w[s] for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_query_meets_targets(spark):
    from semcode.llm.queries import QUERIES
    rows = QUERIES["op10_mix_sources"](spark, SF_MID).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    size, taken, largest = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    want = targets(size)
    assert {(docs[r.doc_id].source, r.source_size) for r in rows} == set(size.items())
    for r in rows:
        assert math.isclose(r.target, want[docs[r.doc_id].source], abs_tol=1e-5)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(rows) == sorted(QUERIES["op10_mix_sources"](spark, SF_MID).collect())


def test_newton_meets_constraints_under_cap_and_priors(spark):
    cells = spark.createDataFrame([("a", 0.1, 500), ("a", 1.0, 300), ("a", 1.9, 200), ("b", 1.0, 1000), ("c", 1.0, 10), (None, 0.5, 70)],
                                  "source string, prior double, size long")
    goal = {"a": 1400.0, "b": 3.0, "c": 20.0, None: 100.0}
    t = spark.createDataFrame(list(goal.items()), "source string, target double")
    mass = {}
    sizes = {(r.source, r.prior): r["size"] for r in cells.collect()}
    for r in M.newton_rates(cells, t).collect():
        assert 0 <= r.rate <= 2
        mass[r.source] = mass.get(r.source, 0) + r.rate * sizes[(r.source, r.prior)]
    for s in goal:
        assert math.isclose(mass[s], goal[s], rel_tol=1e-6), (s, mass[s])


def test_defined_cases(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 30_000, None), (None, "e f", "y"), (5, "g h", "y"),
            (5, "g h", "y"), (6, " \t", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("rank", F.lit(2))
    plan = M.mix_plan(df).collect()
    assert len(plan) == len(rows)
    want = targets({"x": 3, None: 30_000, "y": 6, "z": 0})
    for r in plan:
        assert math.isclose(r.target, want[r.source], abs_tol=1e-5) and 0 <= r.taken <= 2 * r["size"]
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}
    assert M.mix_plan(df.limit(0)).collect() == []
    assert M.mix_plan(df.where("doc_id in (2, 3, 6)")).agg(F.sum("taken")).first()[0] == 0


def test_rows_without_an_id_take_their_own_copies(spark):
    rows = [(None, "w " * (1 + i % 7), "hot") for i in range(600)] + [(7, "w w w", "b")] * 50 + [(8, "v " * 40, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.n for r in M.mix(df).groupBy("source").agg(F.sum(M.n_words(F.col("text"))).alias("n")).collect()}
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for s, goal in targets(size).items():
        assert abs(taken.get(s, 0) - goal) <= 40, (s, taken, goal)
