"""Quality classifier (held-out accuracy) and quality rules (brute force)."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from semcode.llm import quality_classifier as C, quality_rules as R
from tests.conftest import SF_MID, SF_SMALL


def test_classifier_on_held_out_rows(spark):
    from semcode.llm.queries import QUERIES
    out = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, SF_MID).collect()}
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    held = [r for r in labels if r.doc_id in out and out[r.doc_id].held_out]
    assert sum(out[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)


def test_classifier_learns_nothing_from_held_out_labels_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r.doc_id, r.score) for r in C.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_classifier_cases(spark):
    rows = [(1, None), (2, ""), (3, "w " * 50_000), (4, "good text here"), (4, "good text here"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(4, 1), (4, 0), (3, None), (None, 1), (1, 0)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0), labels.where("quality = 0")):
        out = C.classify(df, lab).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert C.classify(df.limit(0), labels).collect() == []


def counts(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_rules_match_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "the", "é", "#x", "|", "Zwölf", "<p>"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a b c d e " * 9_000), (903, " \x0b\x0c\r\n"), (903, "one two"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"),
                                                                        F.lit(None).cast("string").alias("source"),
                                                                        F.lit(1).alias("kept"), F.lit(1).alias("metric"))
    out = sorted((tuple(r[:7]) for r in R.quality_rules(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert out == sorted(((d, *counts(t)) for d, t in rows), key=str)
    assert R.quality_rules(df.limit(0)).collect() == []


def test_sketches_merge_and_fences_adapt(spark):
    clean = "some ordinary words with a few more of them to reach the least length"
    rows = [(i, clean + f" {i}", "en", "s1") for i in range(300)] + [(1000 + i, clean + " ## " * (i % 3), "en", "s2") for i in range(30)]
    rows += [(5000, " ".join(w + "###" for w in clean.split()), "en", "s1"), (5001, clean.upper(), "de", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts_ = R.text_counts(df)
    s = R.sketches(counts_)
    by = {r.level: r.n for r in s.where("metric = 'word_length'").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert by == {0: 332, 1: 332, 2: 332}
    out = {r.doc_id: r.kept for r in R.quality_rules(df).collect()}
    assert not out[5000] and not out[5001]  # far outside s1; de/s9 has one row and takes the corpus sketch
    assert all(out[i] for i in range(300)) and all(out[1000 + i] for i in range(30) if i % 3 < 2)


def test_fences_move_smoothly_with_a_groups_size(spark):
    def fence(n):
        sketch = [(0, None, None, "caps_ratio", -200, 10_000), (1, "en", None, "caps_ratio", -200, 5_000), (2, "en", "s", "caps_ratio", -50, n)]
        s = spark.createDataFrame(sketch, "level int, lang string, source string, metric string, bucket int, n long")
        return R.thresholds(s).first()["caps_ratio_high"]
    value = {b: 2 * R.GAMMA ** b / (R.GAMMA + 1) for b in (-200, -50)}
    prior = value[-200]
    highs = [fence(n) for n in (1, 199, 200, 201, 100_000)]
    for n, high in zip((1, 199, 200, 201, 100_000), highs):
        want = R.GAMMA * (n * value[-50] + R.PRIOR_ROWS * prior) / (n + R.PRIOR_ROWS)
        assert abs(high - want) < 1e-12
    assert highs == sorted(highs) and highs[2] - highs[1] < 0.01 * highs[2] and prior * R.GAMMA < highs[0] < 1.5 * prior


def test_a_few_events_are_free(spark):
    clean = "some ordinary words with a few more of them to reach the least length"
    rows = [(i, clean + f" {i}", "en", "s") for i in range(400)]
    rows += [(1000 + k, clean + " " + "&" * k, "en", "s") for k in (1, 3, 4, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in R.quality_rules(df).collect()}
    assert [out[1000 + k].out_symbol_ratio for k in (1, 3, 4, 30)] == [False, False, True, True]
    assert not any(out[i].out_symbol_ratio for i in range(400))
