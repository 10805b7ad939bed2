"""Vectorised work on UTF-8 buffers inside Arrow tasks: chunks of documents,
word spans and span hashes, without one Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: the white space of all contracts: space and \x09-\x0D
WS_BYTES = b" \t\n\x0b\x0c\r"
IS_WS = np.zeros(256, bool)
IS_WS[list(WS_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: prime moduli below 2**31 with their bases; a hash takes two of them
_FIELDS = ((2147483647, 1103515245), (2147483629, 742938285), (2147483587, 950706376), (2147483579, 1226874159))
#: bytes whose products (40 bits) can be summed without a remainder
_SUMMED = 1 << 23


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary()
    if col.type != kind:
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type)
                       else kind)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(offs: np.ndarray, limit: int = 1 << 21):
    """Ranges of documents of at most ``limit`` bytes together (or one document)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@lru_cache(maxsize=4)
def _powers(field: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the field's base and of its inverse, by doubling."""
    prime, base = _FIELDS[field]
    out = []
    for x in (base, pow(base, -1, prime)):
        a = np.ones(1, np.uint64)
        while len(a) < size:
            a = np.concatenate([a, a * np.uint64(pow(x, len(a), prime)) % np.uint64(prime)])
        out.append(a.astype(np.uint32))
    return out[0], out[1]


def forget_powers() -> None:
    _powers.cache_clear()


def powers(field: int, n: int):
    size = 1 << 21
    while size < n + 1:
        size <<= 1
    return _powers(field, size)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class SpanHash:
    """64-bit hashes of arbitrary byte ranges of one buffer: polynomial prefix sums
    over two prime fields, normalised by the range's start.  ``second`` takes two
    other fields, so that both together are an independent 128-bit hash."""

    def __init__(self, buf: np.ndarray, second: bool = False):
        self.parts = []
        value = buf.astype(np.uint64) + np.uint64(1)
        for field in (2, 3) if second else (0, 1):
            prime = np.uint64(_FIELDS[field][0])
            up, down = powers(field, len(buf))
            g = np.empty(len(buf) + 1, np.uint64)
            g[0] = 0
            term = value * up[:len(buf)]
            if len(buf) > _SUMMED:
                term %= prime
            np.cumsum(term, out=g[1:])
            self.parts.append((prime, down, g))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        (p, down, g), (q, down2, g2) = self.parts
        h = (g[end] - g[start]) % p * down[start] % p
        h2 = (g2[end] - g2[start]) % q * down2[start] % q
        return mix((h << np.uint64(32) | h2) + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions in ``buf``) of the words ``[^\\x20\\x09-\\x0D]+``
    and per document the index of its first word (length n+1).  ``offs`` are
    document boundaries relative to ``buf``."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ws = IS_WS[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = ~ws
    last = first.copy()
    first[1:] &= ws[:-1] | cut[1:n]
    last[:-1] &= ws[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)
