"""License scan against exhaustive edit distances, and its defined cases."""

import random
import re

from pyspark.sql import functions as F

from semcode.llm import license_scan as N
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def least_edits(notice, text):
    """Edits of the best substring of ``text`` (dynamic programming over all of it)."""
    col = list(range(len(notice) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(notice):
            new.append(min(col[i] + (x != c), col[i + 1] + 1, new[i] + 1))
        col, best = new, min(best, new[-1])
    return best


def base(text):
    w = norm(text)
    at = [(i, p) for p in N.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({N.BASE[p] for _, p in at})


def damaged(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcxyz")
        elif kind == 1:
            s.insert(at, rng.choice("abcxyz"))
        else:
            del s[at]
    return "".join(s)


def test_labels_match_exhaustive_search():
    rng = random.Random(2)
    finder = N.Finder()
    filler = "the quick license of a public version under terms and use in software free".split()
    hits = 0
    for _ in range(150):
        label, notice = rng.choice(N.NOTICES)
        text = " ".join([*rng.choices(filler, k=rng.randrange(0, 15)), damaged(rng, notice, rng.randrange(0, len(notice) // 10 + 4)),
                         *rng.choices(filler, k=rng.randrange(0, 15))])
        flat = " ".join(norm(text))
        want = {(lab, n): least_edits(n, flat) for lab, n in N.NOTICES}
        close = {lab for (lab, n), d in want.items() if d <= len(n) // N.CHARS_PER_EDIT}
        found = finder.matches(flat)
        assert {x[0] for x in found} == close, flat
        hits += bool(close)
        for lab, s, e, edits, n in found:
            assert any(least_edits(t, flat[s:e]) <= edits <= len(t) // N.CHARS_PER_EDIT for x, t in N.NOTICES if x == lab and len(t) == n)
    assert hits > 60


def test_query_matches_brute_force(spark):
    from semcode.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, k, first, last, labels = base(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score == 1.0 or not labels)
        assert (r.score > 0) == bool(r.labels)
    assert any("cc-by-nc" in r.labels for r in rows)


def test_fuzzy_finds_and_clean_texts(spark):
    rows = [(1, "Relesed undr the MIT Licence."), (2, "The weather was fine; a licence to fish."), (3, "LICENSED under the\n * Apache-Licence, Version 2.0"),
            (4, "mit license mit license, general public LICENSE"), (5, None), (6, ""), (7, "x " * 200_000 + "Licensed under CC BY-NC 4.0."),
            (None, "Permission is hereby granted, free of charge, to any persn obtaining a copy of this sofware"), (7, "Ä mitÄ license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("id", F.lit(1))
    got = N.license_scan(df).collect()
    assert [list(r.labels) for r in got] == [["mit"], [], ["apache"], ["gpl", "mit"], [], [], ["cc-by-nc"], ["mit"], []]
    assert [r.n_base for r in got] == [0, 0, 0, 3, 0, 0, 0, 0, 0]
    assert (got[3].first_word, got[3].last_word) == (0, 4)
    assert [tuple(s) for s in got[6].spans] == [("cc-by-nc", 200_000, 200_006, 0)] and got[6].score == 1.0
    assert 0.8 < got[0].score < 1
    assert N.license_scan(df.limit(0)).collect() == []


def test_closest_notice_wins():
    finder = N.Finder()
    for label, notice in N.NOTICES:
        assert {x[0] for x in N.closest(finder.matches(f"a {notice} b"))} == {label}
    found = [("a", 0, 10, 2, 10), ("b", 4, 14, 1, 10), ("a", 12, 20, 1, 10), ("c", 30, 40, 3, 10)]
    assert N.closest(found) == found[1:]


def test_pieces_cover_the_notice():
    for _, notice in N.NOTICES:
        k = len(notice) // N.CHARS_PER_EDIT
        got = N.pieces(notice, k)
        assert len(got) == k + N.INTACT and "".join(p for _, p in got) == notice and all(notice[a:a + len(p)] == p for a, p in got)
