"""Repeated byte strings against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from semcode.llm import suffix_dedup as D
from tests.conftest import SF_SMALL


def brute(rows, length=100):
    """(doc, n_bytes, n_removed, n_spans, sha) with a plain dictionary of strings."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = hash(b[s:s + length]), b[s:s + 8]
            if x in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(x)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **kw):
    out = []
    for r in D.repeated_spans(df, **kw).collect():
        raw = (r.text or "").encode()
        n, k, kept = D.cut(raw, r.spans)
        out.append((r.doc, len(raw), n, k, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "and", "of", "a", "é", "ñandú", "tion", "über", "x", "\x00"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(n) for n in (10, 22, 25, 40, 120)]
    rows = []
    for i in range(120):
        t = say(rng.choice([0, 3, 30, 80]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(shared) + t[at:]
        if rows and rng.random() < 0.3:
            t = rng.choice(rows)[1]
            if rng.random() < 0.7 and t:
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(words) + t[at + 3:]
        rows.append((i * 2, t))
    rows.append((1, "ab" * 400))
    rows.append((3, "a" * 1000))
    rows.append((5, "\x00" * 300 + "z" + "\x00" * 150))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 200_000), (2, 2), (3, 1)])
def test_matches_brute_force(spark, seed, hot):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, hot=hot) == brute(rows)


def test_query_matches_brute_force(spark):
    from semcode.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, SF_SMALL).collect()) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = texts(4)
    rows.append((900, " ".join(t for _, t in rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(D, "PIECE", 700)
    import numpy as np
    from semcode.llm.bytesnp import utf8
    import pyarrow as pa
    parts = list(D._pieces(*utf8(pa.array([rows[-1][1]]))))
    assert len(parts) > 5 and sum(max(0, len(p[1]) - 99) for p in parts) == len(rows[-1][1].encode()) - 99
    assert all(np.diff(p[2])[0] <= 799 for p in parts)
    monkeypatch.undo()
    assert got(df) == brute(rows)


def test_defined_cases(spark):
    same = "q" * 50 + "r" * 70
    rows = [(None, same), (1, None), (2, ""), (3, "short"), (4, same), (4, same), (5, "x" + same)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("t", F.lit(2))
    out = {(r.doc, D.cut((r.text or "").encode(), r.spans)[0]) for r in D.repeated_spans(df).collect()}
    assert out == {(D.NULL_ID, 0), (1, 0), (2, 0), (3, 0), (4, 120), (5, 120)}
    assert D.repeated_spans(df.limit(0)).collect() == []


@pytest.mark.parametrize("length", [50, 200])
def test_pieces_overlap_by_the_length_asked_for(spark, length):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=D.PIECE + 1000))
    over = long[D.PIECE - length // 2:D.PIECE + length // 2]
    df = spark.createDataFrame([(1, long), (2, over)], "doc_id long, text string")
    assert [(d, n, gone, runs) for d, n, gone, runs, _ in got(df, length=length)] == [(1, len(long), 0, 0), (2, length, length, 1)]


def test_rows_without_an_id_stay_apart(spark):
    """Two texts that agree in 31 bits of their hash, and a copy of one of them."""
    from pyspark.sql import functions as F
    many = spark.range(300_000).select(F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256)
                                                         for i in range(4)]).alias("text"))
    pair = (many.groupBy(F.expr("pmod(xxhash64(text), 2147483647)").alias("k")).agg(F.collect_list("text").alias("t"))
            .where("size(t) > 1").first()["t"][:2])
    df = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (5, "x " + pair[0])], "doc_id long, text string")
    removed = {}
    for r in D.repeated_spans(df).collect():
        removed[r.text] = D.cut(r.text.encode(), r.spans)[0]
    assert removed == {pair[0]: 0, pair[1]: 0, "x " + pair[0]: len(pair[0])}
