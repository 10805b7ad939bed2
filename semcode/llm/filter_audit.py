"""Filter interaction audit: what each of five filters removes, in every order.

1. *Facts.*  One narrow pass computes per document the failed filters A to D (they
   depend on the text alone) and a 64-bit hash of the text; texts stay behind.
2. *Counting-Bloom prepass.*  Every partition counts its hashes in a sketch of
   saturating counters (0, 1, 2 or more), sent as compressed blocks; blocks are
   merged by a saturating sum.  A text one of whose counters stays at 1 is
   guaranteed to occur once.  The merged sketch is one bit per counter, at most
   ``MAX_COUNTERS`` of them (32 MB), whatever the corpus; that is what is broadcast.
   A fuller sketch clears fewer texts and never a wrong one.
3. *Exact ids.*  Only possible repeats are read again and shuffled, grouped by the
   full text with map-side combining, to its smallest id.
4. *Additive masks.*  The rows that hold their text's smallest id pass E.  The five
   flags join into a mask; documents per (part, mask) are all that the 120 orders
   need, as documents passing a set of filters are a sum over masks.

Hot groups: a group of equal texts is combined before the shuffle; joins meet on
(id, hash), never on the text; counts are partial aggregates.

Defined cases: null text is empty; null part counts as the empty string; a row with
a null id neither fails E nor makes others fail it and has no label; rows with one
id and one text do not fail E for each other; several label rows of an id count as
one (good or toxic if any says so); an empty table gives an empty table; a part is
reported in all 120 orders and 5 steps, zeros included; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcode.llm.bytesnp import mix
from semcode.llm.shared import discard, materialize

FILTERS = "ABCDE"
#: counters a document's hash sets, and counters per document
HASHES, COUNTERS_PER_ROW = 3, 16
BLOCK = 1 << 16
MAX_COUNTERS = 1 << 28
FLUSH_ROWS = 1 << 20
_SEED = np.random.Generator(np.random.PCG64(1107)).integers(1, 2**64 - 1, HASHES, dtype=np.uint64)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8: the text fails A, B, C, D."""
    n, distinct = F.size(_words(text)), F.size(F.array_distinct(_words(text)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
             text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def n_counters(rows: int) -> int:
    """A power of two from ``BLOCK`` to ``MAX_COUNTERS``, by the number of rows."""
    return min(MAX_COUNTERS, max(BLOCK, 1 << (COUNTERS_PER_ROW * max(rows, 1) - 1).bit_length()))


def _places(h: np.ndarray, counters: int) -> list[np.ndarray]:
    """The distinct counters of every hash (a repeated one is given as -1)."""
    out = []
    for s in _SEED:
        at = (mix(h ^ s) & np.uint64(counters - 1)).astype(np.int64)
        for earlier in out:
            at[at == earlier] = -1
        out.append(at)
    return out


def _partial(counters: int):
    """Hashes of a partition to ``(block, once, twice)``: counters that reach 1 and 2."""
    def pack(at):
        bits = np.zeros(BLOCK, bool)
        bits[at] = True
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    def flush(held):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        at, n = at[at >= 0], n[at >= 0]
        cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
        rows = [(int(a[0] // BLOCK), pack(a % BLOCK), pack(a[k > 1] % BLOCK))
                for a, k in zip(np.split(at, cuts), np.split(n, cuts)) if len(a)]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                                           pa.array(cols[2], pa.binary())], names=["block", "once", "twice"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            held += _places(h, counters)
            rows += len(h)
            if rows >= FLUSH_ROWS:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)
    return run


def _merge(batches):
    """Saturating sum of the partial blocks of a partition, one bit per counter left."""
    once, twice = {}, {}
    for b in batches:
        for block, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two))
            had = once.get(block)
            twice[block] = two if had is None else twice[block] | two | (had & one)
            once[block] = one if had is None else had | one
    yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()),
                                      pa.array([x.tobytes() for x in twice.values()], pa.binary())], names=["block", "twice"])


def repeat_sketch(hashes: DataFrame, counters: int) -> bytes:
    """``counters`` bits: those that two or more rows of the one hash column set."""
    parts = hashes.mapInArrow(_partial(counters), "block int, once binary, twice binary")
    merged = parts.repartition("block").mapInArrow(_merge, "block int, twice binary")
    out = bytearray(counters // 8)
    for r in merged.toLocalIterator():  # at most MAX_COUNTERS bits together
        out[r["block"] * BLOCK // 8:(r["block"] + 1) * BLOCK // 8] = r["twice"]
    return bytes(out)


def possible_repeat(sketch, counters: int):
    """Column function on the hash: False if the sketch clears the text as unique."""
    def test(h: pd.Series) -> pd.Series:
        bits = np.frombuffer(sketch.value, np.uint8)
        maybe = np.ones(len(h), bool)
        for at in _places(h.to_numpy().view(np.uint64), counters):
            maybe &= (at < 0) | ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(maybe)
    return F.pandas_udf(test, "boolean")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "source") -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``: documents by the set of filters they fail."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    facts = materialize(docs.select(F.col(id_col).alias("id"), part.alias("part"), text_mask(text).alias("mask"),
                                    F.xxhash64(text).alias("h")), "facts")
    counters = n_counters(facts.count())
    sketch = spark.sparkContext.broadcast(repeat_sketch(facts.select("h"), counters))
    maybe = possible_repeat(sketch, counters)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("t")).where("id is not null").withColumn("h", F.xxhash64("t"))
    first = texts.where(maybe("h")).groupBy("t", "h").agg(F.min("id").alias("lo")).select(
        F.col("lo").alias("id"), "h", F.lit(True).alias("keeper")).distinct()
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = (facts.where("id is not null").withColumn("maybe", maybe("h")).join(first, ["id", "h"], "left")
             .withColumn("mask", F.expr("mask + if(maybe and keeper is null, 16, 0)")).select("id", "part", "mask")
             .join(marks, "id", "left").select("part", "mask", "good", "toxic"))
    rest = facts.where("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    out = materialize(known.unionByName(rest).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("n_good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("n_toxic")), "masks")
    sketch.destroy()
    discard(facts)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """Every part, order and step from the mask counts; see the module's text."""
    every = F.sequence(F.lit(0), F.lit(31))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # <= 32

    def passing(field):  # by set of filters: documents that pass all of it
        return F.transform(every, lambda s: F.aggregate(
            F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda acc, c: acc + c[field]))

    alone = F.transform(every, lambda s: F.aggregate(F.filter("cells", lambda c: c["mask"] == s), F.lit(0).cast("long"),
                                                     lambda acc, c: acc + c["n"]))
    p = cells.select("part", alone.alias("alone"), *[passing(f).alias(f) for f in ("n", "n_good", "n_toxic")])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = p.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.instr(F.lit(FILTERS), x) - 1).cast("int"))
    steps = steps.withColumn("bits", bits).withColumn("bit", F.get("bits", F.col("step") - 1)).withColumn(
        "past", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, b: acc + b))
    get = lambda field, at: F.get(field, at)
    lost = lambda field, at: get(field, at) - get(field, at + F.col("bit"))
    # a filter removes alike after any order of the same earlier set: |P|! (4 - |P|)! orders
    weight = F.array(*[F.lit(w) for w in (24, 6, 4, 6, 24)])
    shapley = F.aggregate(F.filter(every, lambda s: s.bitwiseAND(F.col("bit")) == 0), F.lit(0).cast("long"),
                          lambda acc, s: acc + F.get(weight, F.bit_count(s)) * lost("n", s))
    return steps.select(
        "part", "filter_order", "step", get("n", F.col("past") + F.col("bit")).alias("kept"),
        lost("n", F.col("past")).alias("removed"),
        (lost("n", F.lit(0)) - lost("n", F.col("past"))).alias("redundant"), get("alone", F.col("bit")).alias("unique_fails"),
        lost("n_good", F.col("past")).alias("good_lost"), lost("n_toxic", F.col("past")).alias("toxic_lost"),
        shapley.alias("shapley"))
