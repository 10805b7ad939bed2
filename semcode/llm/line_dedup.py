"""Line deduplication by range-partitioned line hashes.

``line_bitmaps`` returns per document a compressed keep bitmap, not text:

1. every line's key (stripped, A-Z lower-cased) becomes a 128-bit hash.  Inside
   an Arrow batch the lines of a key that are not in the batch's smallest
   document are already known to fall, so only one document per key and batch
   travels: a line that a third of all rows hold costs one row per batch;
2. hashes are range-partitioned and sorted by (hash, document, position); one
   streaming pass per partition keeps the first document of a key;
3. dropped positions are gathered per document into a packed, deflated bitmap.

Defined cases: null or empty text is one empty line, which is kept; keys
shorter than ``min_chars`` code points never fall; repeated lines inside the
first document stay; rows with the same id count as one document (each row
keeps its own bitmap, found by id and text hash); rows without an id are left
whole and are no evidence against others; an empty table gives an empty table.
Extra columns are ignored by ``line_bitmaps`` and kept by ``apply_bitmaps``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.llm.bytesnp import WS_BYTES
from semcode.llm.shared import tidy

_ROWS = "kind tinyint, h1 long, h2 long, doc long, rid long, pos int"
LINE, DROPPED, DOC = 0, 1, 2


def _row_batch(kind, h1, h2, doc, rid, pos):
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int8()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
         pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(pos, pa.int32())],
        names=["kind", "h1", "h2", "doc", "rid", "pos"])


def _line_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            docs, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys, doc, rid, pos, counts = [], [], [], [], []
            for i, (d, r) in enumerate(zip(docs, rids)):
                text = batch.column(2)[i].as_py() or ""
                lines = text.encode().split(b"\n")
                counts.append(len(lines))
                for p, line in enumerate(lines):
                    k = line.strip(WS_BYTES)
                    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode()) < min_chars):
                        continue
                    keys.append(hashlib.blake2b(k.lower(), digest_size=16).digest())
                    doc.append(d)
                    rid.append(r)
                    pos.append(p)
            n = len(docs)
            d, r = np.array(docs, np.int64), np.array(rids, np.int64)
            yield _row_batch(np.full(n, DOC, np.int8), d ^ r, np.zeros(n, np.int64), d, r,
                             np.array(counts, np.int32))
            if not keys:
                continue
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            d, r, p = np.array(doc, np.int64), np.array(rid, np.int64), np.array(pos, np.int32)
            order = np.lexsort((p, d, h[:, 1], h[:, 0]))
            h, d, r, p = h[order], d[order], r[order], p[order]
            new = np.ones(len(d), bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            low = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            fall = d != low
            yield _row_batch(np.where(fall, DROPPED, LINE).astype(np.int8),
                             np.where(fall, d ^ r, h[:, 0]), np.where(fall, 0, h[:, 1]), d, r, p)
    return run


def _first_occurrence(batches):
    """Stream sorted rows: a line falls when its key's first document is another."""
    last, owner = None, None
    for b in batches:
        kind, h1, h2, doc, rid, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        out = kind.copy()
        at = np.flatnonzero(kind == LINE)
        if len(at):
            a, c, d = h1[at], h2[at], doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            low = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            if last == (a[0], c[0]):
                low = low.copy()
                low[np.cumsum(new) == 1] = owner
            out[at[d != low]] = DROPPED
            last, owner = (a[-1], c[-1]), low[-1]
        keep = out != LINE
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep], pa.int64()), pa.array(rid[keep], pa.int64()),
             pa.array(np.where(out[keep] == DOC, pos[keep], -1).astype(np.int32)),
             pa.array(np.where(out[keep] == DROPPED, pos[keep], -1).astype(np.int32))],
            names=["doc", "rid", "n_lines", "drop"])


def _pack(batches):
    for b in batches:
        n_lines = b.column(2).to_numpy(zero_copy_only=False)
        dropped, maps = [], []
        for n, at in zip(n_lines, b.column(3).to_pylist()):
            bits = np.ones(n, np.uint8)
            bits[at] = 0
            dropped.append(int(n - bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc", "rid", "n_lines", "n_dropped", "keep_bitmap"])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 10) -> DataFrame:
    """``(doc, rid, n_lines, n_dropped, keep_bitmap)``; ``rid`` is the text's xxhash64."""
    rows = (docs.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("rid"),
                    F.col(text_col).alias("text"))
            .mapInArrow(tidy(_line_rows(min_chars)), _ROWS))
    falls = (rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
             .mapInArrow(tidy(_first_occurrence), "doc long, rid long, n_lines int, drop int"))
    return (falls.groupBy("doc", "rid")
            .agg(F.max("n_lines").alias("n_lines"),
                 F.collect_list(F.when(F.col("drop") >= 0, F.col("drop"))).alias("falls"))
            .mapInArrow(tidy(_pack), "doc long, rid long, n_lines int, n_dropped int, keep_bitmap binary"))


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines before dropping, lines dropped, kept text of one document."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    if keep.all():
        return len(lines), 0, text or ""
    return len(lines), int(len(lines) - keep.sum()), "\n".join(x for x, k in zip(lines, keep) if k)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``__keep`` (null: keep all)."""
    b = bitmaps.select(F.col("doc").alias("__d"), F.col("rid").alias("__r"), F.col("keep_bitmap").alias("__keep"))
    return (docs.withColumn("__x", F.xxhash64(text_col))
            .join(b, (F.col(id_col) == F.col("__d")) & (F.col("__x") == F.col("__r")), "left")
            .drop("__d", "__r", "__x"))


def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([kept_text(t, b)[2] for t, b in zip(text, bitmap)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and each text reduced to its kept lines (null stays null)."""
    cut = F.when(F.col("__keep").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(
        F.pandas_udf(_apply, "string")(F.col(text_col), F.col("__keep")))
    return with_bitmaps(docs, bitmaps, id_col, text_col).withColumn(text_col, cut).select(*docs.columns)
