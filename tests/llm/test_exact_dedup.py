"""Exact dedup by block naming against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from semcode.llm import exact_dedup as X


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((d, best, len(g), d == best, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in X.exact_dedup(df, **kw).collect()), key=str)


def test_matches_brute_force_through_several_rounds(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 3, 8, 9, 40, 130]))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(250)]
    rows += [(1000 + i, t[:-1] + "x") for i, (_, t) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (4, 4096):
        assert got(df, block_bytes=size) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "ab"), (4, "a  b"), (5, "a b"), (5, "a b"), (6, "x" * 50_000),
            (7, "x" * 50_000 + " "), (8, "\xa0"), (9, "X")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("level", F.lit(2))
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
