"""Exact deduplication by deterministic block naming.

A document's normalised text (all ``[\\x20\\x09-\\x0D]`` deleted) is cut into
fixed-size blocks.  Equal blocks are dealt to one partition, each partition is
sorted by block, and every distinct block gets an integer name (partition number
and running number), so equal blocks, and only those, share a name; no hash
decides (it only deals).  Then adjacent names are
paired, the distinct pairs are sorted and named the same way, and so on until
every document has one name.  Two documents are equal when they finish in the
same round with the same name.

Rounds: log2(blocks of the longest document).  A hot group costs one row per
Arrow batch for its blocks (owners are listed beside the block) and one row per
distinct pair afterwards.

Defined cases: null text counts as empty; all empty texts form one group;
ties for the row that stays go to the smallest id, null ids last; rows with
the same id are separate rows (``kept`` is true for each row that has the kept
id); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.llm.bytesnp import WS_BYTES
from semcode.llm.shared import discard, materialize

BLOCK_BYTES = 4096

_OWNER = pa.struct([("tag", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("doc", pa.int64()),
                    ("chars", pa.int64()), ("sha", pa.string())])
_OWNERS = "array<struct<tag: long, pos: int, n: int, doc: long, chars: long, sha: string>>"


def _blocks(size: int):
    def run(batches):
        for batch in batches:
            owners = defaultdict(list)
            for tag, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                norm = text.encode().translate(None, WS_BYTES)
                n = max(1, -(-len(norm) // size))
                sha = hashlib.sha256(norm).hexdigest()
                for k in range(n):
                    # what a row returns travels with its first block only
                    owners[norm[k * size:(k + 1) * size]].append(
                        (tag, k, n, doc, len(text), sha) if k == 0 else (tag, k, n, None, None, None))
            keys = list(owners)
            for i in range(0, len(keys), 2000):
                part = keys[i:i + 2000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()),
                     pa.array([[dict(zip(("tag", "pos", "n", "doc", "chars", "sha"), o)) for o in owners[k]]
                               for k in part], pa.list_(_OWNER))],
                    names=["block", "owners"])
    return run


def _name(batches):
    """Sorted rows in, the same rows with the integer name of their key out."""
    base = TaskContext.get().partitionId() << 40
    last, name = object(), base - 1
    for b in batches:
        keys = list(zip(*(c.to_pylist() for c in b.columns[:b.num_columns - 1])))
        names = []
        for k in keys:
            if k != last:
                last, name = k, name + 1
            names.append(name)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())],
                                         names=[*b.schema.names, "name"])


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc, chars, sha, level, name)``: one row per input row; (level, name)
    is the collision-free identity of its normalised text."""
    rows = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).cast("long").alias("doc"),
                       F.col(text_col).alias("text"))
    named = (rows.mapInArrow(_blocks(block_bytes), f"block binary, owners {_OWNERS}")
             .repartition("block").sortWithinPartitions("block")
             .mapInArrow(_name, f"block binary, owners {_OWNERS}, name long")
             .select("name", F.inline("owners")))
    level = materialize(named.select("tag", "pos", "n", "doc", "chars", "sha", "name"), "blocks")
    rounds = max(0, (level.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    done = level.where("n = 1").select("doc", "chars", "sha", F.lit(0).alias("level"), "name")
    for k in range(1, rounds + 1):
        pairs = (level.where("n > 1").groupBy("tag", F.expr("pos div 2").cast("int").alias("pos"))
                 .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                      F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1).cast("long")).alias("b"),
                      F.max(F.expr("cast((n + 1) div 2 as int)")).alias("n"),
                      F.max("doc").alias("doc"), F.max("chars").alias("chars"), F.max("sha").alias("sha")))
        pairs = materialize(pairs, "pairs")
        names = (pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b")
                 .withColumn("last", F.lit(0)).mapInArrow(_name, "a long, b long, last int, name long").drop("last"))
        level = materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "names")
        discard(pairs)
        done = done.unionByName(level.where("n = 1").select("doc", "chars", "sha", F.lit(k).alias("level"), "name"))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` per input row: of equal
    texts the row with most code points, then the smallest id, stays."""
    ids = block_identities(docs, id_col, text_col, block_bytes)
    groups = ids.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc").isNull().alias("z"), F.col("doc"))).alias("best"))
    return (ids.join(groups, ["level", "name"])
            .select(F.col("doc").alias(id_col), F.col("best.doc").alias("keep_id"), "group_size",
                    F.col("doc").eqNullSafe(F.col("best.doc")).alias("kept"), F.col("sha").alias("text_sha256")))
