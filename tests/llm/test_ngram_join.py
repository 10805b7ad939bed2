"""N-gram Jaccard join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from semcode.llm import ngram_join as J
from tests.conftest import SF_SMALL


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, set()).add(i)
    pairs = {(i, j) for v in by.values() for i in v for j in v if i < j} if len(rows) < 400 else None
    if pairs is None:
        pairs = set()
        for i, (_, s) in enumerate(sets):
            near = {}
            for g in s:
                for j in by[g]:
                    if j > i:
                        near[j] = near.get(j, 0) + 1
            pairs |= {(i, j) for j in near}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        n = len(a & b)
        if n and den * n >= num * (len(a) + len(b) - n):
            x, y = find(sets[i][0]), find(sets[j][0])
            up[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


def got(df, **kw):
    return {tuple(r) for r in J.ngram_components(df, **kw).collect()}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for g in range(8):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 7, 12, 30, 90, 200]))]
        for _ in range(n // 8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w + passage
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,cell,k,num", [(1, 2_000_000, 4, 85), (2, 900, 5, 80), (3, 300, 4, 85)])
def test_near_copies_match_brute_force(spark, seed, cell, k, num):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    refine = {2_000_000: 200_000, 900: 1, 300: 2_000}[cell]
    assert got(df, k=k, num=num, cell_grams=cell, refine_grams=refine) == brute(rows, k, num, 100)


def test_query_matches_brute_force(spark):
    from semcode.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op8_ngram_join"](spark, SF_SMALL).collect()} == brute(rows, 4, 85, 100)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, "x"),
            (9, "p q r s t"), (10, "p q r s t"), (11, "x"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("fp", F.lit(2))
    out = {(r.doc_id, r.component_id) for r in J.ngram_components(df, k=4, num=85).collect()}
    assert out == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (10, 9), (11, 9), (None, None)}
    assert J.ngram_components(df.limit(0)).collect() == []
    kept = J.keep_one(df, J.ngram_components(df, k=4, num=85))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, None}


def test_segments_find_every_link():
    """Sets at the threshold share a non-empty segment, whatever their sizes."""
    import numpy as np
    rng = np.random.default_rng(5)
    for num in (80, 85):
        lev = J.Levels(num, 100)
        for n in [*range(4, 60), 99, 250, 700]:
            for m in {n, n + 1, 100 * n // num}:
                u = (n + m) * 100 // (100 + num)
                i = n + m - u
                while 100 * i < num * u:
                    i, u = i + 1, u - 1
                if i > n or u == i:
                    continue
                grams = rng.integers(0, 2**63, n + m - i).astype(np.uint64)
                a, b = grams[:n], np.concatenate([grams[n - i:n], grams[n:]])
                assert np.intersect1d(J.segment_keys(a, lev), J.segment_keys(b, lev)).size, (num, n, m)


def test_structured_bytes_do_not_collide(spark):
    """Thue-Morse words and their complements defeat polynomials modulo 2**64."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    tail = " same words after the long one here"
    df = spark.createDataFrame([(1, t + tail), (2, other + tail), (3, t + tail)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.ngram_components(df, k=5, num=80, den=100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components_of_chains_stars_and_cliques(spark):
    from semcode.llm.shared import components
    import numpy as np
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 2000 + i) for i in range(500)] + [(9000, 3000 + i) for i in range(500)]
    edges += [(5000 + int(a), 5000 + int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(5, 5), (7777, 7777)]
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    def root(x):
        while want[x] != x:
            x = want[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        want[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = [tuple(r) for r in components(df).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in linked)
    assert components(df.limit(0)).collect() == []


def test_every_block_is_cut_by_prefixes(spark, monkeypatch):
    """The prefix step takes all sets that share a segment, not those of large blocks
    only: a threshold made its rows grow faster than the input."""
    rows, cut, whole = near_copies(4), [], J._refined
    monkeypatch.setattr(J, "_refined", lambda members, *a: cut.append({r.rep for r in members.collect()}) or whole(members, *a))
    out = got(spark.createDataFrame(rows, "doc_id long, text string"), k=5, num=80)
    assert out == brute(rows, 5, 80, 100)
    assert len(cut) == 1 and len(cut[0]) > 1
