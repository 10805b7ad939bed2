"""Repeated byte strings by prefix-free parsing.

Every ``length``-byte string that also starts earlier (smaller id, or earlier in
the same document) is covered; matches never cross documents.

1. *Parse.*  Windows of ``window`` bytes get a rolling hash; the trigger of a
   string is its leftmost window with the least hash, so equal strings have
   their trigger at the same place.  Consecutive strings with one trigger form
   a phrase: its left context, the trigger and what follows.
2. *Dictionary.*  Equal phrases are grouped; all but the first are covered whole.
   Highly repetitive text ends here: only distinct phrases go on, and of these
   only the ones whose trigger occurs in another distinct phrase.
3. *Order.*  Per trigger, two suffix arrays are sorted: the left contexts read
   backwards (suffixes of the dictionary) and the right contexts (the parse that
   follows), with their common prefixes.  For each distance from start to trigger
   the two orders combine: strings are equal when they share the left class and
   the right class.  All but the first of a class are covered.

Skew: within a chunk of text, equal phrases are met before the shuffle (one row
per phrase and chunk); step 2 streams sorted rows in constant memory; a trigger
with more than ``hot`` distinct phrases leaves step 3 for a grouping by the
strings' own 128-bit hashes, with partial aggregation.  Step 1 and 2 compare
128-bit hashes, step 3 bytes.

Defined cases: null or empty texts have no bytes; a null id comes before all
others; texts shorter than ``length`` lose nothing; rows with the same id and
text are one document (each row is reported); texts that share an id are
ordered by their hash; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semcode.llm.bytesnp import SpanHash, chunks, mix, utf8
from semcode.llm.shared import materialize

LENGTH = 100
WINDOW = 32
HOT = 200_000
PIECE = 1 << 22  # longer documents are parsed in overlapping pieces
PLACE_BITS = np.uint64(24)  # of a window's place within a piece
BLOCK_ROWS = 100_000
NULL_ID = -(1 << 63)
_CTX = np.uint64(0xA0761D6478BD642F)


def parse(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, window: int = WINDOW):
    """Phrases of a piece: (trigger place, first start, last start, document,
    trigger hash, phrase hash), or None without any."""
    n, reach = len(buf), length - window + 1
    lens = np.diff(offs)
    long = np.flatnonzero(lens >= length)
    if not len(long):
        return None
    g = SpanHash(buf)
    at = np.arange(n - window + 1)
    h = g(at, at + window)
    low = (h >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[:len(low) - (reach - span)], low[reach - span:])
    # starts whose string lies within one document
    first, count = offs[long], lens[long] - length + 1
    head = np.cumsum(count) - count
    start = np.repeat(first - head, count) + np.arange(count.sum())
    place = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    new[head] = True
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(start)) - 1
    b, lo, hi = place[a], start[a], start[z]
    phrase = mix(g(lo, hi + length) + (b - lo).astype(np.uint64) * _CTX)
    return b, lo, hi, np.repeat(long, count)[a], h[b], phrase


def _pieces(data, offs, length: int = LENGTH):
    """(row, bytes, boundaries, place of the bytes in the row) of bounded size;
    every ``length``-byte string starts in one piece."""
    for i, j in chunks(offs):
        if offs[j] - offs[i] <= PIECE:
            yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], 0
        else:
            doc = data[offs[i]:offs[j]]
            for x in range(0, len(doc), PIECE):
                part = doc[x:x + PIECE + length - 1]
                yield i, part, np.array([0, len(part)]), x


_FOUND = "t long, doc long, rid long, off long, left int, n int, covered boolean"
_ROWS = "t long, c long, doc long, rid long, off long, left int, n int, covered boolean"


def _phrases(length: int, window: int):
    def run(batches):
        for batch in batches:
            doc, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, buf, offs, shift in _pieces(*utf8(batch.column(2)), length):
                found = parse(buf, offs, length, window)
                if found is None:
                    continue
                b, lo, hi, d, t, c = found
                off, left, n = b - offs[d] + shift, b - lo, hi - lo + 1
                d = d + i
                d, r = doc[d], rid[d]
                t, c = t.view(np.int64), c.view(np.int64)
                order = np.lexsort((off, r, d, c, t))
                t, c, d, r, off, left, n = (x[order] for x in (t, c, d, r, off, left, n))
                again = np.zeros(len(t), bool)
                again[1:] = (t[1:] == t[:-1]) & (c[1:] == c[:-1])
                t = np.where(again, mix(d.view(np.uint64)).view(np.int64), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(np.where(again, 0, c)), pa.array(d), pa.array(r, pa.int64()), pa.array(off),
                     pa.array(left, pa.int32()), pa.array(n, pa.int32()), pa.array(again)],
                    names=["t", "c", "doc", "rid", "off", "left", "n", "covered"])
    return run


def _dictionary(batches):
    """Rows sorted by (t, c, order): ``covered`` for all but the first of a phrase;
    firsts stay only where their trigger has another phrase."""
    def rows(t, doc, rid, off, left, n, covered):
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (t, doc, rid, off, left, n, covered)],
            names=["t", "doc", "rid", "off", "left", "n", "covered"])

    held = None  # the first phrase of the running trigger, while it is alone
    last = None  # (t, c) before this batch
    for b in batches:
        t, c, doc, rid, off, left, n, was = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        if was.any():
            yield rows(t[was], doc[was], rid[was], off[was], left[was], n[was], was[was])
        t, c, doc, rid, off, left, n = (x[~was] for x in (t, c, doc, rid, off, left, n))
        if not len(t):
            continue
        new_t, new_c = np.ones(len(t), bool), np.ones(len(t), bool)
        new_t[1:] = t[1:] != t[:-1]
        new_c[1:] = new_t[1:] | (c[1:] != c[:-1])
        if last is not None and t[0] == last[0]:
            new_t[0], new_c[0] = False, c[0] != last[1]
        last = (t[-1], c[-1])
        again = ~new_c
        if again.any():
            yield rows(t[again], doc[again], rid[again], off[again], left[again], n[again], again[again])
        f = np.flatnonzero(new_c)
        if not len(f):
            continue
        head = new_t[f]
        nxt = np.append(~head[1:], False)  # followed by another phrase of the same trigger
        if held is not None and not head[0]:
            yield held
        if not head.all() or held is not None:
            held = None
        keep = ~head | nxt
        if keep.any():
            k = f[keep]
            yield rows(t[k], doc[k], rid[k], off[k], left[k], n[k], np.zeros(len(k), bool))
        if head[-1]:
            k = f[-1:]
            held = rows(t[k], doc[k], rid[k], off[k], left[k], n[k], np.zeros(1, bool))


def _contexts(length: int):
    """Join rows (doc, rid, text, phrases) to context rows with their bytes."""
    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            data = data.tobytes() if len(data) else b""
            out = []
            for r, (doc, rid, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                      batch.column(3).to_pylist())):
                for p in found or ():
                    lo = offs[r] + p["off"] - p["left"]
                    out.append((p["t"], doc, rid, p["off"], p["left"], p["n"], data[lo:lo + p["n"] + length - 1], p["hot"]))
            for x in range(0, len(out), 20_000):
                cols = list(zip(*out[x:x + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, ty) for v, ty in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                                                             pa.int32(), pa.binary(), pa.bool_()))],
                    names=["t", "doc", "rid", "off", "left", "n", "bytes", "hot"])
    return run


def _classes(order: np.ndarray, common: np.ndarray, need: int) -> np.ndarray:
    """Class number per row: neighbours in ``order`` sharing ``need`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < need)
    return out


def _sorted_common(rows: np.ndarray, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of fixed-width byte rows and the common prefix with the row before."""
    width = rows.shape[1]
    keys = rows if group is None else np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    keys = np.ascontiguousarray(keys)
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.full(len(rows), -1, np.int64)
    common[1:] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    if group is not None:
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def covered_starts(group, rank, left, n, buf, cuts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance from start to trigger) of every string that an earlier row
    of its group (smaller ``rank``) holds as well."""
    g = len(group)
    width = int(left.max()) if g else 0
    back = np.zeros((g, max(1, width)), np.uint8)
    k = np.arange(back.shape[1])
    at = cuts[:-1, None] + left[:, None] - 1 - k
    has = k < left[:, None]
    back[has] = buf[at[has]]
    front = np.zeros((g, length), np.uint8)
    k = np.arange(length)
    has = k < (cuts[1:] - cuts[:-1] - left)[:, None]
    at = cuts[:-1, None] + left[:, None] + k
    front[has] = buf[at[has]]
    order_l, common_l = _sorted_common(back, None)
    order_r, common_r = _sorted_common(front, group)
    rows, dist = [], []
    for x in range(width + 1):
        valid = np.flatnonzero((left >= x) & (left - n < x))
        if len(valid) < 2:
            continue
        cls = _classes(order_r, common_r, length - x)[valid] * (g + 1) + _classes(order_l, common_l, x)[valid]
        order = np.lexsort((rank[valid], cls))
        cls = cls[order]
        again = np.flatnonzero(cls[1:] == cls[:-1]) + 1
        rows.append(valid[order[again]])
        dist.append(np.full(len(again), x))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(dist)


def merge(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted-by-start intervals (touching ones join)."""
    if not len(s):
        return s, e
    top = np.maximum.accumulate(e)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > top[:-1]
    f = np.flatnonzero(new)
    return s[f], top[np.append(f[1:], len(s)) - 1]


def _order(length: int):
    """Context rows sorted by trigger: whole triggers are ordered together, in
    blocks of about ``BLOCK_ROWS`` rows."""
    def solve(parts):
        t, doc, rid, off, left, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(6))
        text = pa.chunked_array([p.column(6) for p in parts])
        buf, cuts = utf8(text)
        group = np.cumsum(np.append(True, t[1:] != t[:-1]))
        order = np.lexsort((off, rid, doc))
        rank = np.empty(len(t), np.int64)
        rank[order] = np.arange(len(t))
        row, dist = covered_starts(group, rank, left.astype(np.int64), n.astype(np.int64), buf, cuts, length)
        s = off[row] - dist
        by = np.lexsort((s, row))
        row, s = row[by], s[by]
        # strings of one row that overlap become one interval
        new = np.ones(len(s), bool)
        new[1:] = (row[1:] != row[:-1]) | (s[1:] > s[:-1] + length)
        f = np.flatnonzero(new)
        e = s[np.append(f[1:], len(s)) - 1] + length if len(f) else s[:0]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row[f]]), pa.array(rid[row[f]], pa.int64()), pa.array(s[f]), pa.array(e)],
            names=["doc", "rid", "s", "e"])

    def run(batches):
        parts, rows = [], 0
        for b in batches:
            t = b.column(0).to_numpy()
            while len(t):
                if rows >= BLOCK_ROWS:  # end the block where the trigger changes
                    stop = int(np.searchsorted(t, parts[-1].column(0)[-1].as_py(), side="right"))
                    if stop:
                        parts.append(b.slice(0, stop))
                    b, t = b.slice(stop), t[stop:]
                    if len(t):
                        yield solve(parts)
                        parts, rows = [], 0
                    continue
                take = min(len(t), BLOCK_ROWS - rows)
                parts.append(b.slice(0, take))
                rows += take
                b, t = b.slice(take), t[take:]
        if parts:
            yield solve(parts)
    return run


def _string_rows(length: int):
    """Context rows to one row per string: 128-bit hash and place."""
    def run(batches):
        for b in batches:
            buf, cuts = utf8(b.column(6))
            doc, rid, off, left, n = (b.column(i).to_numpy() for i in range(1, 6))
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lo, hi = cuts[0], cuts[-1]
            at = cuts[row] - lo + k
            one, two = SpanHash(buf[lo:hi]), SpanHash(buf[lo:hi], second=True)
            for x in range(0, len(row), 200_000):
                r, a = row[x:x + 200_000], at[x:x + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one(a, a + length).view(np.int64)), pa.array(two(a, a + length).view(np.int64)), pa.array(doc[r]),
                     pa.array(rid[r], pa.int64()), pa.array(off[r] - left[r] + k[x:x + 200_000])],
                    names=["k1", "k2", "doc", "rid", "s"])
    return run


def row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, rid, text)``; neither key part can be null, so joins add no filter
    to the scan and share one exchange of the texts."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.xxhash64(text_col).alias("rid"),
                       F.col(text_col).alias("text"))


def covered_intervals(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``(doc, rid, s, e)``: byte intervals covered by repeated strings (they may overlap)."""
    rows = (docs.mapInArrow(_phrases(length, window), _ROWS)
            .repartition("t").sortWithinPartitions("t", "c", "doc", "rid", "off")
            .mapInArrow(_dictionary, _FOUND))
    found = materialize(rows, "phrases")
    whole = found.where("covered").select("doc", "rid", (F.col("off") - F.col("left")).alias("s"),
                                          (F.col("off") - F.col("left") + F.col("n") + (length - 1)).alias("e"))
    some = found.where("not covered")
    many = some.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("t", F.lit(True).alias("hot"))
    any_hot = len(many.take(1)) > 0
    some = some.join(many, "t", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else \
        some.withColumn("hot", F.lit(False))
    per_doc = some.groupBy("doc", "rid").agg(F.collect_list(F.struct("t", "off", "left", "n", "hot")).alias("found"))
    contexts = (docs.join(per_doc, ["doc", "rid"]).select("doc", "rid", "text", "found")
                .mapInArrow(_contexts(length), "t long, doc long, rid long, off long, left int, n int, bytes binary, hot boolean"))
    if any_hot:
        contexts = materialize(contexts, "contexts")
    ordered = (contexts.where("not hot").repartition("t").sortWithinPartitions("t")
               .mapInArrow(_order(length), "doc long, rid long, s long, e long"))
    out = whole.union(ordered)
    if any_hot:
        strings = contexts.where("hot").mapInArrow(_string_rows(length), "k1 long, k2 long, doc long, rid long, s long")
        first = strings.groupBy("k1", "k2").agg(F.min(F.struct("doc", "rid", "s")).alias("m"))
        out = out.union(strings.join(first, ["k1", "k2"]).where(F.struct("doc", "rid", "s") != F.col("m"))
                        .select("doc", "rid", "s", (F.col("s") + length).alias("e")))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``(doc, text, spans)`` per row: covered byte intervals, null without any."""
    d = row_key(docs, id_col, text_col)
    cover = covered_intervals(d, length, window, hot).groupBy("doc", "rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    # the texts meet the phrases and the spans under one key: one exchange serves both joins
    return d.join(cover, ["doc", "rid"], "left").select("doc", "text", "spans")


def cut(text: bytes, spans) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, remaining bytes."""
    if not spans:
        return 0, 0, text
    se = np.array([(x["s"], x["e"]) for x in spans], np.int64)
    se = se[np.argsort(se[:, 0], kind="stable")]
    s, e = merge(se[:, 0], se[:, 1])
    keep = [text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)])]
    return int((e - s).sum()), len(s), b"".join(keep)
