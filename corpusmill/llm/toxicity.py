"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are counts of hashed words, words cut to their first STEM bytes (so
that inflected forms share a feature), word pairs and pairs that skip one or two words
(words as in ``words.ALNUM``). FTRL-proximal keeps a learning rate per
coordinate and, by L1, few weights other than zero; those are sent to the tasks. Scoring
is one narrow pass over the whole texts.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import words as W
from corpusmill.llm.sample import fold, per_label
from corpusmill.session import dropped, written

BITS = 20
STEM = 4
#: Gaps between the two words of a pair: neighbours, one and two words skipped.
GAPS = (1, 2, 3)
#: Labelled rows a class to fit on, and the most words that such a row may have (scored texts may have any number).
TRAIN_ROWS = 4000
TRAIN_WORDS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.01, 12
THRESHOLD = 0.3


def _slots(h: np.ndarray, gap: int) -> np.ndarray:
    """Feature numbers of all words (gap 0), stems (-1) or pairs with that gap, by place of the first word."""
    if gap <= 0:
        x = W.mix(h, 1 - gap * 16)
    else:
        x = W.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:], 1 + gap)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of one text."""
    data = np.frombuffer(text, np.uint8)
    h, _, _, _, stems = W.tokenize(data, np.array([0, len(data)]), W.ALNUM, STEM)
    return np.unique(np.concatenate([_slots(stems, -1), *[_slots(h, g) for g in (0, *GAPS) if len(h) > g]]), return_counts=True)


class Ftrl:
    """The per-coordinate FTRL-proximal learner with a free intercept."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0  # the intercept stands last
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0, w)

    def fit_one(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def examples(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(k, y, at, x) of the drawn labelled texts outside the held-out fold, written in many parts: the driver takes in one at a time."""
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    drawn = per_label(seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", rows, "doc_id")
    # at most 4 * rows labels of two numbers each: a bounded broadcast
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("text", F.xxhash64("doc_id").alias("k"), "toxic")

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            kept, data = [], [[], [], [], []]
            for k in range(b.num_rows):
                at, x = features(b.column(0)[k].as_buffer().to_pybytes())
                if x.sum() <= TRAIN_WORDS * (2 + len(GAPS)):
                    kept.append(k)
                    data[0].append(at.astype(np.int32).tobytes())
                    data[1].append(x.astype(np.int32).tobytes())
            r = b.take(pa.array(kept, pa.int64()))
            return pa.RecordBatch.from_arrays([r.column(1), r.column(2).cast(pa.int32()), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary())], names=["k", "y", "at", "x"])

        return one

    return written(W.per_text(texts, ["text", "k", "toxic"], make, "k long, y int, at binary, x binary"), "examples")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, intercept), learnt from rows outside the held-out fold.

    Labels are drawn first (narrow rows, bounded by ``rows`` a class), so that no text is
    moved for the join. A document with several labels counts as toxic if one says so;
    null labels and null texts take no part; without any label the score is 0.5.
    """
    got = examples(docs, labels, rows)
    train = sorted((r.k, r.y, bytes(r.at), bytes(r.x)) for r in islice(got.toLocalIterator(), 4 * rows))
    dropped(got)
    model = Ftrl()
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            _, y, at, x = train[i]
            model.fit_one(np.frombuffer(at, np.int32), np.log1p(np.frombuffer(x, np.int32)), y)
    w = model.weights(slice(None))
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    The score looks at the text alone. Null and empty texts get the intercept's score;
    repeated rows get equal scores; an empty table gives an empty table. Texts of any
    length are read whole; counts enter as log(1 + count), as in training.
    """
    at, w, bias = fit(docs, labels, rows)

    def make():
        table = np.zeros(1 << BITS, np.float32)
        table[at] = w
        used = np.zeros(1 << BITS, bool)
        used[at] = True

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = W.utf8(b.column(0))
            h, _, _, ends, stems = W.tokenize(data, offs, W.ALNUM, STEM)
            n = b.num_rows
            seen = []
            for g in (-1, 0, *GAPS):
                if len(h) > g:
                    s = _slots(h if g >= 0 else stems, g)
                    k = np.flatnonzero(used[s])
                    text = np.searchsorted(ends, k, "right") - 1
                    inside = k + max(g, 0) < ends[text + 1]
                    seen.append(text[inside] << BITS | s[k[inside]])
            code, count = np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_counts=True)
            logit = bias + np.bincount(code >> BITS, np.log1p(count) * table[code & ((1 << BITS) - 1)], n)[:n]
            p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_ = docs.select("text", "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"))
    return W.per_text(rows_, ["text", "doc_id", "held_out"], make, f"doc_id {kind}, held_out boolean, score double, predicted int")
