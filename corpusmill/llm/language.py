"""Language identification by a byte-level convolutional network.

Bytes are embedded; filters of widths 2, 3 and 4 slide over fixed-length windows; max
pooling over the places and a softmax follow. It is trained in numpy with Adam on a
bounded sample of labelled texts. For inference the embedding and each filter are
multiplied out into tables by byte pair, so a convolution is a look-up and an addition,
over batches of windows. Every window of a whole text counts, weighted by its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import words as W
from corpusmill.llm.sample import fold, per_label
from corpusmill.session import tuned

WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 8
#: Bytes of a window, in training and in use.
WINDOW = 512
#: Labelled texts a language to fit on; one window of each is used.
TRAIN_ROWS = 800
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: A filtering stage rejects texts without a letter and texts in which no language reaches this probability (mean over all windows).
LEAST = 0.2
NONE = "und"


class Net:
    """Parameters, training and the tables for inference."""

    def __init__(self, classes: int, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
        self.p["o"] = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.p["b"] = np.zeros(classes, np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows x (n, WINDOW) and its gradients; pooled values pass a rectifier."""
        n, p = len(x), self.p
        e, pooled, best = p["e"][x], [], []
        for w in WIDTHS:
            places = x.shape[1] - w + 1
            conv = sum(e[:, k : k + places] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w))
            best.append(conv.argmax(1))
            pooled.append(conv.max(1))
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        s = a @ p["o"] + p["b"]
        s -= s.max(1, keepdims=True)
        q = np.exp(s)
        q /= q.sum(1, keepdims=True)
        loss = float(-np.log(q[np.arange(n), y] + 1e-9).mean())
        ds = q
        ds[np.arange(n), y] -= 1
        ds /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["b"] = a.T @ ds, ds.sum(0)
        dh = (ds @ p["o"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            d, at = dh[:, j * FILTERS : (j + 1) * FILTERS], best[j]
            for k in range(w):
                byte = x[rows, at + k]
                part = slice(k * EMBED, (k + 1) * EMBED)
                g[f"w{w}"][part] += np.einsum("nfe,nf->ef", p["e"][byte], d)
                np.add.at(g["e"], byte, d[:, :, None] * p[f"w{w}"][part].T[None])
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                at = order[lo : lo + BATCH]
                t += 1
                for k, g in self.gradients(x[at], y[at])[1].items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By byte pair: the first two places of all filters; by byte: place 3 of width 3; by pair: places 3 and 4 of width 4."""
        e, p = self.p["e"], self.p

        def pair(w: int, k: int) -> np.ndarray:
            a, b = (e @ p[f"w{w}"][i * EMBED : (i + 1) * EMBED] for i in (k, k + 1))
            return (a[:, None] + b[None]).reshape(65536, FILTERS)

        return np.concatenate([pair(w, 0) for w in WIDTHS], 1), e @ p["w3"][2 * EMBED :], pair(4, 2)

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW)."""
        first, third, last = tables
        out, f = np.empty((len(x), len(self.p["b"])), np.float32), FILTERS
        for lo in range(0, len(x), 32):
            b = x[lo : lo + 32].astype(np.uint16)
            pairs = (b[:, :-1] << 8) | b[:, 1:]
            c = first[pairs]
            c[:, :-1, f : 2 * f] += third[b[:, 2:]]
            c[:, :-2, 2 * f :] += last[pairs[:, 2:]]
            h = np.concatenate([c[:, :, :f].max(1), c[:, :-1, f : 2 * f].max(1), c[:, :-2, 2 * f :].max(1)], 1)
            s = np.maximum(h, 0) @ self.p["o"] + self.p["b"]
            s = np.exp(s - s.max(1, keepdims=True))
            out[lo : lo + 32] = s / s.sum(1, keepdims=True)
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts (A-Z lowered, the last of each padded by blanks), their text and their bytes."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[text + 1] - start)
    out = np.full((len(text), WINDOW), 32, np.uint8)
    full = length == WINDOW
    if full.any():
        out[full] = W.LOWER[data[start[full][:, None] + np.arange(WINDOW)]]
    for i in np.flatnonzero(~full):
        out[i, : length[i]] = W.LOWER[data[start[i] : start[i] + length[i]]]
    return out, text, length


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~has):
        raw = data[offsets[k] : offsets[k + 1]]
        if (raw >= 128).any():
            has[k] = any(c.isalpha() for c in raw.tobytes().decode(errors="replace"))
    return has


class Model:
    """A net with its languages; predicts texts of an Arrow column."""

    def __init__(self, net: Net | None, names: list[str]):
        self.net, self.names, self.tables = net, names, None

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offs = W.utf8(column)
        n = len(column)
        if self.net is None:
            return [NONE] * n, np.zeros(n)
        if self.tables is None:
            self.tables = self.net.tables()
        total = np.zeros((n, len(self.names)))
        at = 0
        while at < n:  # texts of about a MB at once; a longer text goes through in parts
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + W.PIECE_BYTES, "right")) - 1)
            for lo in range(int(offs[at]), max(int(offs[end]), int(offs[at]) + 1), W.PIECE_BYTES if end == at + 1 else 1 << 62):
                cut = np.clip(offs[at : end + 1], lo, min(int(offs[end]), lo + W.PIECE_BYTES) if end == at + 1 else None)
                x, text, length = windows(data, cut)
                if len(x):
                    np.add.at(total[at:end], text, self.net.predict(x, self.tables) * length[:, None])
            at = end
        ok = _lettered(data, offs)
        share = total / np.maximum(np.diff(offs), 1)[:, None]
        best = share.argmax(1)
        return [self.names[k] if y else NONE for k, y in zip(best, ok)], np.where(ok, np.clip(share[np.arange(n), best], 0, 1), 0.0)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and lang of documents outside the held-out fold, a bounded sample of each language.

    Rows whose text or lang is null take no part; without labelled rows the model knows no language.
    """
    seen = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    start = F.greatest(F.lit(1), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int"))
    got = [(r.lang, r.k, r.t) for r in per_label(seen, "lang", rows, "doc_id").select("lang", F.xxhash64("doc_id").alias("k"), F.substring(F.col("text"), start, F.lit(WINDOW)).alias("t")).collect()]
    names = sorted({r[0] for r in got})
    if not names:
        return Model(None, [])
    xs, ys = [], []
    for lang in names:
        for _, _, t in sorted(r for r in got if r[0] == lang)[:rows]:
            raw = np.frombuffer(t.encode()[:WINDOW].ljust(WINDOW), np.uint8)
            xs.append(W.LOWER[raw])
            ys.append(names.index(lang))
    net = Net(len(names))
    net.fit(np.array(xs), np.array(ys))
    del got, xs, ys
    W.release()  # the driver goes on to other stages
    return Model(net, names)


def predict(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Texts that are null or hold no letter are ``und`` with score 0. Texts of any length are read whole.
    Repeated rows get equal answers; an empty table gives an empty table; other columns aren't looked at.
    """
    model = fit(docs, rows)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = model.predict(b.column(0))
            return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_ = docs.select("text", "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"))
    return W.per_text(rows_, ["text", "doc_id", "held_out"], make, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, least: float = LEAST, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, all columns unchanged, whose text has a letter and one language of at least ``least``; null and empty texts go."""
    tuned(docs.sparkSession)
    model, column = fit(docs, rows), docs.columns.index("text")

    def run(batches):
        for b in W.chunks(batches, column):
            lang, score = model.predict(b.column(column))
            known = np.array([x != NONE for x in lang], bool)
            yield b.filter(pa.array(known & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
