"""Secret scan against Python's regular expressions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from semcode.llm import secret_scan as S


def brute(text):
    found = []
    for rank, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text or "", re.A):
            if len(m.group(r.value)) >= r.least:
                found.append((m.start(), rank, m.end(), r.kind))
    return sorted(found)


def report(text):
    f = brute(text)
    join = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in x)
    base = [x for x in f if x[1] < 3]
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(join(base).encode()).hexdigest(), join(f))


def test_trigram_queries_hold_for_every_match():
    assert S.trigram_query(r"[0-9a-f]+") == S.TRUE and S.trigram_query(r"ab?c*") == S.TRUE
    assert set(S.trigram_query(r"(?:abc|abd)x?z")) == {frozenset({"abc", "bcz"}), frozenset({"abc", "bcx", "cxz"}),
                                                      frozenset({"abd", "bdz"}), frozenset({"abd", "bdx", "dxz"})}
    samples = {"assign": ["PassWord: abcdef1", "api_key=zzzzzz", "apikey = '123456'", "SECRET:x12345"], "access": ["AKIA" + "A" * 16],
               "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], "code_host": ["ghp_" + "a" * 36],
               "chat": ["xoxb-1234567890"], "web_token": ["eyJhbGciOiJ.eyJzdWIiOiI.abcdefgh"], "cloud_key": ["AIza" + "x" * 35],
               "payment": ["rk_live_" + "9" * 16]}
    for r in S.RULES:
        for text in samples.get(r.kind, []):
            assert re.search(r.pattern, text)
            low = text.lower()
            assert any(all(t in low for t in b) for b in S.trigram_query(r.pattern)), (r.kind, text)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "apiXkey", " = ", ":", "=", "'", '"', " ", "\n", "AKIA", "0123456789abcdef",
            "deadbeef", "A1B2C3D4E5F6G7H8", "xyz+/=", "é🙂", "ghp_", "abcdefghijklmnopqrstuvwxyz0123456789", "eyJ", ".", "-----BEGIN ", "PRIVATE KEY-----",
            "xoxb-", "AIza", "sk_live_", "İ", "K"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "token=abc token=abcdef " * 3_000), (703, "x" * 60_000 + "AKIA" + "Z" * 20), (None, "secret=abcdefg"),
             (704, "secret=abcdefg"), (704, "hi"), (704, "secret=abcdefg"), (705, "token=token: abcdefg"), (706, "a" * 24 + "g" + "a" * 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(1)).withColumn("trigram", F.lit(2))
    out = sorted((tuple(r) for r in S.report(S.spans(df)).collect()), key=str)
    assert out == sorted(((d, *report(t)) for d, t in rows), key=str)
    assert S.report(S.spans(df.limit(0))).collect() == []
