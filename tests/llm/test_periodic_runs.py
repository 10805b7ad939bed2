"""Periodic runs against brute force, and their defined cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from semcode.llm import periodic_runs as P
from tests.conftest import SF_SMALL


def brute(w):
    """Runs of every period by comparing all words q apart; the smallest period wins."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                if not any(q % p == 0 and s <= i and j + q <= s + m for s, m, p in out):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sample(rng):
    kind = rng.randrange(6)
    letters = "ab" if kind < 2 else "abcd" if kind < 4 else [str(i) for i in range(60)]
    w = [rng.choice(letters) for _ in range(rng.randrange(0, 300))]
    for _ in range(rng.randrange(0, 4)):
        p = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
        p = p * rng.randrange(1, 6) if kind % 2 else p  # periods inside periods
        at = rng.randrange(0, len(w) + 1)
        w[at:at] = (p * rng.randrange(2, 9))[:rng.randrange(1, 500)]
    return w


def test_runs_match_brute_force(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 900)
    rng = random.Random(4)
    texts = [sample(rng) for _ in range(400)]
    fib = ["a", "b"]
    while len(fib) < 700:
        fib += fib[:len(fib) * 5 // 8]
    texts += [["a"] * 1000, fib, (["a"] * 9 + ["b"]) * 50, ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 4 + ["a"], list("aab") * 4]
    for w, (words, got) in zip(texts, P.text_runs([" ".join(w) for w in texts])):
        assert [x.decode() for x in words] == w
        assert got == brute(w), w


def planted(doc, w):
    h = zlib.crc32(str(doc).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc, text):
    w = planted(doc, [x.decode() for x in (text or "").encode().split()])
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_matches_brute_force(spark):
    from semcode.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    docs = [r for r in docs if len((r.text or "").split()) < 3000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF_SMALL).collect()}
    assert sum(expected(r.doc_id, r.text)[1] > 0 for r in docs) > 3
    for r in docs:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_defined_cases(spark):
    long = "x y z " * 100_000 + "end " * 50
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (4, "a a a a a a"), (None, "a b a b a b a b"), (5, "\u00e9\u00a0\u00e9 " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("id", F.lit(2))
    out = {(r.doc_id, r.n_words): r for r in P.periodic_runs(df).collect()}
    assert len(out) == 7 and P.periodic_runs(df.limit(0)).collect() == []
    assert [tuple(x) for x in out[(4, 300_050)].runs] == [(0, 300_000, 3), (300_000, 50, 1)]
    assert out[(4, 300_050)].collapsed == "x y z end"
    assert [tuple(x) for x in out[(4, 6)].runs] == [(0, 6, 1)] and [tuple(x) for x in out[(None, 8)].runs] == [(0, 8, 2)]
    assert len(out[(5, 6)].runs) == 1 and out[(1, 0)].collapsed == ""


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_sliding_minimum(width):
    import numpy as np
    h = np.random.default_rng(width).integers(0, 2**63, 200).astype(np.uint64)
    assert P._least(h, width).tolist() == [min(h[i:i + width]) for i in range(200 - width + 1)]
