"""Line dedup against brute force, and its defined cases."""

import random

from pyspark.sql import functions as F

from semcode.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def key(line):
    k = line.strip(WS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows):
    """(doc, n_lines, n_dropped, kept) per row; rows with one id are one document."""
    holders = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        xs = (t or "").split("\n")
        keep = [x for x in xs if d is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(xs), len(xs) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def got(df):
    rows = L.with_bitmaps(df, L.line_bitmaps(df)).select("doc_id", "text", "__keep").collect()
    return sorted(((r[0], *L.kept_text(r[1], r[2])) for r in rows), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = ["The same LINE here", " the same line HERE\t", "short", "äöüäöüäöüä", "ÄÖÜÄÖÜÄÖÜÄ", "nine char", "ten chars!", "",
            "A very common line of the table"] + [f"line number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(12))))
            for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df.repartition(7)) == brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # keys meet only after the shuffle
    try:
        assert got(df.repartition(7)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_defined_cases(spark):
    same = "a line that several documents hold"
    rows = [(None, same), (1, None), (2, ""), (3, same), (3, same + "\nown"), (4, same), (4, same), (5, "\n" + same + "\n"),
            (6, "\n".join(f"long text, line {i}" for i in range(50_000))), (7, "long text, line 7\nlong text, line 50000")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("rid", F.lit(2))
    assert got(df) == brute(rows)
    cut = L.apply_bitmaps(df, L.line_bitmaps(df))
    assert cut.columns == df.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert (None, same) in texts and (1, None) in texts and (4, "") in texts and (5, "\n") in texts
    assert L.line_bitmaps(df.limit(0)).collect() == [] and got(df.limit(0)) == []
