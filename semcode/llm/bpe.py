"""Byte-level BPE through a sentencepiece model written from the rank file.

The vocabulary's ranks become a sentencepiece BPE model without training: each
byte is mapped to one printable character, each token to the mapped string,
with score ``-rank`` and id ``rank``; normalisation is the identity.  The best
scored merge is then the lowest-ranked one, as in byte-level BPE.  Texts are
split by the vocabulary's pattern; each distinct short pre-token is encoded
once per task and cache (``CACHE_BYTES``, freed when the task ends) and ids are
concatenated.  Decoding maps ids back to
pieces and pieces back to bytes.

Defined cases: null or empty text has no tokens; special-token strings are
ordinary text; repeated rows and ids are encoded row by row; an empty table
gives an empty table; extra columns are ignored by ``encode`` unless named in
``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semcode.llm.shared import tidy

#: text and id bytes of the cached pre-tokens, and the longest one that is cached
CACHE_BYTES, CACHED_CHARS = 8 << 20, 48
#: byte b is written as the character with this code point (a block of letters
#: without case, white space or normalisation of their own)
BYTE_CHAR = [chr(0x4E00 + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; ranks must be 0..n-1."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (field 1), trainer_spec (2), normalizer_spec (3)."""
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(BYTE_CHAR[b] for b in token).encode()
        score = np.float32(-rank).tobytes()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + score))
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _flag(3, 2)))
    n = len(tokens)
    out.append(_field(2, _flag(3, 2) + _flag(4, n + 1) + _flag(40, n)))  # model_type BPE, vocab_size, unk_id
    out.append(_field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, pattern: str, cache_bytes: int = CACHE_BYTES):
        import regex
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.to_char = dict(enumerate(BYTE_CHAR))
        self.cache: dict[str, bytes] = {}
        self.held, self.limit = 0, cache_bytes
        inverse = {c: b for b, c in enumerate(BYTE_CHAR)}
        self.piece_bytes = [bytes(map(inverse.__getitem__, p)) for p in
                            (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size() - 1))]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        cache, own = self.cache, {}
        new = [t for t in set(tokens) if t not in cache]
        mapped = [t.encode().decode("latin-1").translate(self.to_char) for t in new]
        for t, ids in zip(new, self.sp.encode(mapped, num_threads=1)):
            own[t] = np.array(ids, "<u4").tobytes()
        out = b"".join([cache[t] if t in cache else own[t] for t in tokens]) if own else b"".join(map(cache.__getitem__, tokens))
        for t, ids in own.items():
            if len(t) <= CACHED_CHARS:
                cache[t] = ids
                self.held += len(t) + len(ids)
        if self.held > self.limit:
            cache.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _per_text(model: bytes, pattern: str, text_at: int, names: list[str], types: list, fn: Callable):
    def run(batches):
        c = Codec(model, pattern)
        for b in batches:
            rest = [i for i in range(b.num_columns) if i != text_at]
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [fn(c, t.as_py() or "") for t in part.column(text_at)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in rest), *(pa.array(x, t) for x, t in zip(zip(*rows), types))],
                    names=[*(part.schema.names[i] for i in rest), *names])
    return tidy(run)


def _model(path: str) -> bytes:
    return serialize_model(read_ranks(path))


def _keep(docs: DataFrame, keep: tuple[str, ...], text_col: str, out: str) -> tuple[DataFrame, str]:
    d = docs.select(*keep, text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes[:-1])
    return d, schema + ", " + out


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
           text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``n_tokens`` and ``ids`` (array of int) per row."""
    d, schema = _keep(docs, keep, text_col, "n_tokens long, ids array<int>")

    def one(c, text):
        ids = np.frombuffer(c.encode(text), "<u4").astype(np.int32)
        return len(ids), ids
    return d.mapInArrow(_per_text(_model(path), pattern, len(keep), ["n_tokens", "ids"],
                                  [pa.int64(), pa.list_(pa.int32())], one), schema)


def decode(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
           ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``bytes`` (binary) from an id column; null decodes to nothing."""
    model = _model(path)
    d, schema = _keep(tokens, keep, ids_col, "bytes binary")

    def run(batches):
        c = Codec(model, pattern)
        for b in batches:
            out = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(out, pa.binary())],
                                             names=[*b.schema.names[:len(keep)], "bytes"])
    return d.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids, in one pass: ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` (and ``ids``) beside the ``keep`` columns."""
    d, schema = _keep(docs, keep, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string"
                      + (", ids array<int>" if with_ids else ""))

    def one(c, text):
        ids = c.encode(text)
        out = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
        return (*out, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else out
    return d.mapInArrow(_per_text(_model(path), pattern, len(keep),
                                  ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
                                  [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())], one), schema)
