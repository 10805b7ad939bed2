"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot
products over Arrow buffers.

Features of a text are hashed into ``2**bits`` slots: word uni- and bigrams
(A-Z lower-cased), and the same n-grams over the words' shapes.  A shape is the
word's sequence of character classes with runs collapsed ("Thre***" -> "Xx*"),
marked when the word equals the one before it; shapes let the model judge words
it has never seen.  Every feature counts with its share of the text's words, so
the score does not depend on the length.

Training reads a documented, bounded sample in one task: one row per id, the
``max_train`` ids with the smallest hash, and of these in hash order as many as hold
``max_words`` words together (at most 8 bytes for each of four features a word are
held, so about 256 MB).  Scoring is one narrow pass over all rows with the weights
broadcast (``8 * 2**bits`` bytes).

Defined cases: null or empty text scores the bias alone; several labels of one
id count by their mean; of rows sharing an id the least text is learnt; null labels and null ids train nothing; no labels at
all, or labels of one class only, still give a model (the bias moves); rows are
scored one by one, repeated or not; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcode.llm.bytesnp import LOWER, SpanHash, chunks, mix, utf8, word_spans
from semcode.llm.shared import give_back, tidy

BITS = 18
MAX_TRAIN = 12_000
MAX_WORDS = 8_000_000
THRESHOLD = 0.7

#: character classes: upper X, lower x (and every non-ASCII byte), digit 9, others themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 88
_CLASS[97:123] = 120
_CLASS[48:58] = 57
_CLASS[128:] = 120

_A = np.uint64(0x9FB21C651E98DF25)
_B = np.uint64(0xD6E8FEB86659FD93)


def _features(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, value, document) of every n-gram occurrence of a chunk, by document."""
    starts, ends, at = word_spans(buf, offs)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0), z
    word = SpanHash(LOWER[buf])(starts, ends)
    kind = _CLASS[buf]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    runs = np.concatenate(([0], np.cumsum(new)))
    shape = SpanHash(kind[new])(runs[starts], runs[ends])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    pair = doc[1:] == doc[:-1]
    again = np.zeros(len(word), bool)
    again[1:] = pair & (word[1:] == word[:-1])
    shape = np.where(again, mix(shape + _B), shape)
    mask = np.uint64((1 << bits) - 1)
    share = 1.0 / np.maximum(1, np.diff(at))[doc]
    parts = []
    for h, salt in ((word, _A), (shape, _B)):
        parts.append((mix(h + salt), doc, share))
        parts.append((mix(h[:-1] * _A + h[1:] * _B + salt)[pair], doc[1:][pair], share[1:][pair]))
    slot = np.concatenate([p[0] for p in parts]) & mask
    doc = np.concatenate([p[1] for p in parts])
    return slot.astype(np.int64), np.concatenate([p[2] for p in parts]), doc


def _each(col, bits: int):
    data, offs = utf8(col)
    for i, j in chunks(offs):
        rel = offs[i:j + 1] - offs[i]
        yield i, j, _features(data[offs[i]:offs[j]], rel, bits)


class Ftrl:
    """FTRL-proximal over ``2**bits`` slots and a bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slot: np.ndarray, value: np.ndarray, label: float) -> None:
        """One row: its distinct slots with their values."""
        at, x = np.append(slot, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "order",
          bits: int = BITS, epochs: int = 3, max_words: int = MAX_WORDS) -> np.ndarray:
    """Weights from a bounded labelled table: one task, rows in ``order_col`` order
    up to the one in which ``max_words`` words are reached."""
    def run(batches):
        rows, left = [], 4 * max_words
        for b in batches:
            labels = b.column(1).to_pylist()
            for i, j, (slot, value, doc) in _each(b.column(0), bits):
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(j - i + 1))
                for k in range(j - i):
                    if left <= 0:
                        break
                    of = order[cuts[k]:cuts[k + 1]]
                    at, where = np.unique(slot[of].astype(np.int32), return_inverse=True)
                    rows.append((at, np.bincount(where, value[of], len(at)).astype(np.float32), float(labels[i + k])))
                    left -= len(of)
        m = Ftrl(bits)
        for _ in range(epochs):
            for row in rows:
                m.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights().tobytes()], pa.binary())], names=["w"])

    t = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label"),
                        F.col(order_col).alias("o"))
    w = (t.repartition(1).sortWithinPartitions("o", "text").select("text", "label")
         .mapInArrow(tidy(run), "w binary").collect())
    return np.frombuffer(w[0]["w"]) if w else Ftrl(bits).weights()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_train: int = MAX_TRAIN, bits: int = BITS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Learn from the ``max_train`` labelled ids with the smallest hash.  The ids (8
    bytes each, at most ``max_train``) are broadcast to pick the texts, so no text
    is shuffled but theirs."""
    ids = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("label"))
           .withColumn("order", F.xxhash64("__id")).orderBy("order", "__id").limit(max_train))
    picked = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("text")).join(
        F.broadcast(ids), F.col("__d") == F.col("__id"))
    picked = picked.groupBy("__d", "label", "order").agg(F.min("text").alias("text"))
    return train(picked, bits=bits, max_words=max_words)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> Column:
    """A column expression with the score (0 to 1) of the text column."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        try:
            for text in texts:
                out = np.full(len(text), w[-1])
                for i, j, (slot, value, doc) in _each(text, bits):
                    out[i:j] += np.bincount(doc, w[slot] * value, j - i)
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))
        finally:
            give_back()
    return F.arrow_udf(run, "double")(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted``; held-out labels are not learnt from."""
    weights = fit(docs, labels.where(~held_out(id_col)), id_col, text_col)
    return (docs.withColumn("held_out", held_out(id_col)).withColumn("score", score(docs, weights, text_col))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
