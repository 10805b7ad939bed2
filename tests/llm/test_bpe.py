"""The codec against the tiktoken library, and round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from semcode.llm import bpe
from tests.conftest import SF_SMALL

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(bpe.serialize_model(bpe.read_ranks(PATH)), P.PATTERN, cache_bytes=500)


def check(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TIK.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_odd_texts():
    for t in ("", " ", "  a  b\t\n\n x", "<|endoftext|> <unk> ▁ ▁a", "a" * 5000, "\x00\x01", "🙂🙂‍👩 ﬁ Ａ１", "'s've 123"):
        check(t)


def test_query_and_cases(spark):
    from semcode.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, SF_SMALL).collect():
        ids = TIK.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2))
    enc = bpe.encode(df, PATH, P.PATTERN)
    assert sorted((r.n_tokens, len(r.ids)) for r in enc.collect()) == sorted((n, n) for n in (0, 0, 2, 2, 2, 40_001))
    dec = bpe.decode(enc, PATH, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]).decode() for r in dec) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []
