"""Periodic runs of words by string synchronising sets.

A run (q, [s, e)) is a maximal stretch of words with smallest period q; reported
are runs of length at least ``max(6, 4 q)``.  For every dyadic scale t the periods
t <= q < 2t are found together:

1. Every position's next t words get a hash, built from the hashes of the scale
   below.  Position i is in the synchronising set when the least hash among
   i .. i+t stands at i or i+t.  Whether it is depends on 2t words only, and any t
   successive positions hold one, unless the words there have a period of t/4 or less.
2. Those highly periodic places are known: they lie in the runs that smaller scales
   found.  They are left out of the minima, which keeps the set at O(n / t).
3. In a run with t <= q < 2t each period repeats the same set positions, so two
   successive positions with equal 2t-word contexts, t to 2t-1 words apart, propose
   their distance as a period (a smaller period would have shown a nearer pair).
4. Proposals of one period that overlap are one; it is compared word by word and
   extended to both sides, so hashes only ever propose.

All documents of a chunk are one array with a unique word between documents; a
scale looks at those long enough for it.  Work is O(n log n) per document, memory
linear in one chunk (``CHUNK_WORDS`` or one document).

Defined cases: null or empty text has no words and no runs; a run of one repeated
word has period 1; rows with the same or no id are separate rows; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semcode.llm.bytesnp import mix

CHUNK_WORDS = 1 << 18
#: least length of a run: LEAST words, and EXPONENT periods (the scales rely on 4)
LEAST, EXPONENT = 6, 4
_A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_FAR = np.uint64(2**64 - 1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``h`` over every ``width`` successive positions (block minima
    from the left and from the right)."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    x = np.full(rows * width, _FAR)
    x[:len(h)] = h
    x = x.reshape(rows, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def _extent(w: np.ndarray, at: np.ndarray, q: np.ndarray, step: int, sign: int) -> np.ndarray:
    """How many successive x from ``at`` on (in direction ``sign``) have w[x] = w[x + q]."""
    n, live = np.zeros(len(at), np.int64), np.arange(len(at))
    off = np.arange(step)
    while len(live):
        x = at[live, None] + sign * (n[live, None] + off)
        y = np.clip(x + q[live, None], 0, len(w) - 1)
        x = np.clip(x, 0, len(w) - 1)  # both ends hold a unique word, which stops the count
        differ = w[x] != w[y]
        m = np.where(differ.any(1), differ.argmax(1), step)
        n[live] += m
        live = live[m == step]
    return n


def _verified(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = hi - lo
    first = np.cumsum(n) - n
    x = np.arange(n.sum()) - np.repeat(first - lo, n)
    return np.logical_and.reduceat(w[x] == w[x + np.repeat(q, n)], first)


def runs(w: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of four periods or more.

    ``w`` holds word numbers; a number occurring once stands at both ends and between
    documents.  Documents come longest first; ``reach[k]`` is the length of the prefix
    of ``w`` that holds the documents of at least 4 * 2**k words."""
    found = [np.zeros((0, 3), np.int64)]
    h = mix(w.astype(np.uint64) * _A + _B)
    for k, n in enumerate(reach):
        t = 1 << k
        if n < 4 * t:
            break
        w, h = w[:n], h[:n - t + 1]  # h: hashes of t words at every position
        context = mix(h[:len(h) - t] * _A + mix(h[t:] ^ _B))
        order = h.copy()
        known = np.concatenate(found)
        for s, e, _ in known[(4 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t)].tolist():
            order[s:e - t + 1] = _FAR
        low = _least(order, t + 1)
        m = min(len(low), len(context))
        here = np.flatnonzero((low[:m] != _FAR) & ((order[:m] == low[:m]) | (order[t:t + m] == low[:m])))
        by = np.lexsort((here, context[here]))
        a, b = here[by[:-1]], here[by[1:]]
        pair = (context[a] == context[b]) & (b - a >= t) & (b - a < 2 * t)
        a, q = a[pair], (b - a)[pair]
        if len(a):
            by = np.lexsort((a, q))
            a, q = a[by], q[by]
            new = np.ones(len(a), bool)
            new[1:] = (q[1:] != q[:-1]) | (a[1:] > a[:-1] + 2 * t)
            start = np.flatnonzero(new)
            lo, q, hi = a[start], q[start], a[np.append(start[1:], len(a)) - 1] + 2 * t
            true = _verified(w, lo, hi, q)
            lo, hi, q = lo[true], hi[true], q[true]
            s = lo - _extent(w, lo - 1, q, t, -1)
            e = hi + _extent(w, hi, q, t, 1) + q
            keep = e - s >= EXPONENT * q
            found.append(np.unique(np.stack([s, e, q], axis=1)[keep], axis=0))
        h = context
    return np.concatenate(found)


def text_runs(texts: list[str | None]):
    """Per text its words (bytes) and runs as (start, length, period), by start and period."""
    words = [(t or "").encode().split() for t in texts]
    out = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
    lo = 0
    while lo < len(order) and len(words[order[lo]]) >= LEAST:
        hi, size = lo, 0
        while hi < len(order) and len(words[order[hi]]) >= LEAST and (hi == lo or size + len(words[order[hi]]) <= CHUNK_WORDS):
            size += len(words[order[hi]]) + 1
            hi += 1
        part = order[lo:hi]
        number: dict[bytes, int] = {}
        lens = np.array([len(words[i]) for i in part])
        starts = np.cumsum(lens + 1) - lens  # one separator before every document, one at the end
        w = np.empty(lens.sum() + len(part) + 1, np.int64)
        w[np.append(starts - 1, len(w) - 1)] = -1 - np.arange(len(part) + 1)
        for i, s in zip(part, starts):
            w[s:s + len(words[i])] = [number.setdefault(x, len(number)) for x in words[i]]
        reach = []
        while (k := np.count_nonzero(lens >= (EXPONENT << len(reach)))):
            reach.append(int(starts[k - 1] + lens[k - 1] + 1))
        for s, e, q in runs(w, np.array(reach)).tolist():
            if e - s >= LEAST:
                d = int(np.searchsorted(starts, s, side="right")) - 1
                out[part[d]].append((s - int(starts[d]), e - s, q))
        lo = hi
    return [(x, sorted(r, key=lambda y: (y[0], y[2]))) for x, r in zip(words, out)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    gone = np.zeros(len(words), bool)
    for s, n, q in found:
        gone[s + q:s + n] = True
    return b" ".join([x for x, g in zip(words, gone.tolist()) if not g]).decode()


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches):
    for batch in batches:
        ids, texts, lo = batch.column(0), batch.column(1), 0
        while lo < batch.num_rows:
            hi, size = lo, 0
            part = []
            while hi < batch.num_rows and (hi == lo or size < 4 * CHUNK_WORDS):
                part.append(texts[hi].as_py())
                size += len(part[-1] or "")
                hi += 1
            got = text_runs(part)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(w) for w, _ in got], pa.int64()),
                 pa.array([[dict(start=s, length=n, period=q) for s, n, q in r] for _, r in got], _RUN),
                 pa.array([collapsed(w, r) for w, r in got], pa.string())],
                names=["id", "n_words", "runs", "collapsed"])
            lo = hi


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` per row: ``runs`` by start, then period;
    ``collapsed`` is the text without what repeats after a run's first period."""
    d = docs.select(id_col, text_col)
    return d.mapInArrow(_find, f"id {d.dtypes[0][1]}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                        "collapsed string").withColumnRenamed("id", id_col)
