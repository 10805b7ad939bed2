"""The filter audit against brute force, and its defined cases."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from semcode.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(docs):
    """The set of failed filters per row (doc, part, text)."""
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, _, t in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if d is not None and least[t] < d else set()
        out.append(bad)
    return out


def brute(docs, good, toxic):
    """Every order played through, row by row."""
    bad, out = fails(docs), []
    for part in {p or "" for _, p, _ in docs}:
        rows = [i for i, (_, p, _) in enumerate(docs) if (p or "") == part]
        total, held = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in bad[i]]
                redundant = sum(f in bad[i] for i in rows) - len(gone)
                left = [i for i in left if f not in bad[i]]
                total[f] += len(gone)
                held.append([part, "".join(order), step, len(left), len(gone), redundant, sum(bad[i] == {f} for i in rows),
                             sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone), f])
        out += [(*h[:-1], total[h[-1]]) for h in held]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in A.audit(A.mask_counts(d, lab)).collect())


def words(n, distinct, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, distinct, n))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [words(60, 500, 1), words(60, 20, 2), words(10, 90, 3), words(49, 900, 4), words(50, 900, 5), "AB " * 60, "a # b",
            words(70, 300, 6) + " $x", "", None, " \t\x0b", "x y", "x  y", words(70, 300, 6).upper()]
    docs = [(int(rng.integers(0, 150)), ["a", "b", None, ""][rng.integers(0, 4)], pool[rng.integers(0, len(pool))]) for _ in range(300)]
    docs += [(1000 + i, "a", words(55, 900, 100 + i)) for i in range(40)] + [(None, "b", "x y"), (None, "c", None)]
    docs += [(2000 + i, "hot", "one text of a third of all rows") for i in range(170)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 1200, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    assert run(spark, docs, labels) == brute(docs, good, toxic)


def test_full_sketch_stays_exact(spark, monkeypatch):
    """A sketch that clears nothing costs shuffles, not results."""
    docs = [(i, "a", f"text {i % 50}") for i in range(80)]
    want = run(spark, docs, [])
    monkeypatch.setattr(A, "_places", lambda h, counters: [np.zeros(len(h), np.int64)])
    assert run(spark, docs, []) == want == brute(docs, set(), set())


def test_sketch_clears_unique_texts_only():
    class Held:
        pass
    h = np.random.default_rng(5).integers(-2**62, 2**62, 5000)
    h = np.concatenate([h, h[:700], h[:10]])
    counters = A.n_counters(len(h))
    import pyarrow as pa
    parts = [b for lo in range(0, len(h), 900) for b in A._partial(counters)([pa.record_batch([pa.array(h[lo:lo + 900])], names=["h"])])]
    (merged,) = A._merge(parts)
    bits = bytearray(counters // 8)
    for b, t in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()):
        bits[b * A.BLOCK // 8:(b + 1) * A.BLOCK // 8] = t
    Held.value = bytes(bits)
    import pandas as pd
    maybe = A.possible_repeat(Held, counters).func(pd.Series(h)).to_numpy()
    repeated = np.isin(h, h[:700])
    assert maybe[repeated].all() and maybe[~repeated].mean() < 0.03


def test_defined_cases(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(None, None, None)], []) == brute([(None, None, None)], set(), set())
    long = [(1, "a", "w " * 300_000), (2, "a", "w " * 300_000), (2, "a", "w " * 300_000)]
    assert run(spark, long, []) == brute(long, set(), set())
