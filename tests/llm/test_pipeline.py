"""The pipeline against a brute-force version of its stages."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as CP
from semcode.llm import quality_classifier as C
from tests.conftest import SF_SMALL
from tests.llm import test_line_dedup as TL, test_mixing as TM, test_ngram_join as TJ


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    # the classifier's verdicts are taken as they are; what follows is rebuilt
    good = {r.doc_id for r in C.classify(docs, labels).where("predicted = 1").collect()}
    meta = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(good) < len(meta)
    rows = [(d, meta[d].text) for d in sorted(good)]
    cut = {d: kept for d, _, _, kept in TL.brute(rows)}
    stay = [d for d, _, c in TJ.brute(sorted(cut.items()), CP.SHINGLE_WORDS, *CP.SIMILARITY) if d == c]
    size = {}
    for d in stay:
        size[meta[d].source] = size.get(meta[d].source, 0) + len(cut[d].encode().split())
    want = TM.targets(size)
    out = CP.run(spark, SF_SMALL).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    taken, times = {}, {}
    for r in out:
        text = cut[r.doc_id]
        assert r.doc_id in set(stay) and list(r.ids) == tik.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        taken[r.source] = taken.get(r.source, 0) + len(text.encode().split())
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    for s in want:
        assert abs(taken.get(s, 0) - want[s]) <= max(len(cut[d].encode().split()) for d in stay if meta[d].source == s)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a b c " * 4_000, "en", "s", None), (3, "a b c " * 4_000, "en", "s", 7),
            (None, "no id here at all", "en", "s", 1), (4, "\n\n \n", "de", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        d = frame
        for _, stage in CP.STAGES[:-1]:
            d = stage(spark, d, SF_SMALL)
            assert d.columns == docs.columns
            d = spark.createDataFrame(d.collect(), docs.schema)
        CP.STAGES[-1][1](spark, d, SF_SMALL).collect()
