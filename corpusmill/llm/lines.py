"""Line dedup by winnowing over line hashes.

Lines that aren't blank are hashed. A window is a shortest run of neighbouring lines with at
least WORDS words; of each window the least line hash is its fingerprint, so two
places that share a run of WORDS words always share a fingerprint. Fingerprints that
stand at one place only end the search there. Around the others, the match is extended
both ways: the windows that begin at a line and those that end at one are keyed by their
whole content, and each is compared with the first place of its content. Together they
cover every run with WORDS words or more that occurred before, and nothing else, without
pairing the places of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import words as W
from corpusmill.session import dropped, tuned, written

#: A repeated run of at least so many words (between ASCII white space) goes.
WORDS = 50

#: Shared fingerprints (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

_NOT_END = np.ones(256, bool)
_NOT_END[10] = False
_SAME = np.arange(256, dtype=np.uint8)


def line_table(data: np.ndarray, offsets: np.ndarray):
    """Hashes, starts, ends and word counts of all lines that aren't empty, and the line offsets of the texts."""
    h, starts, ends, at = W.tokenize(data, offsets, _NOT_END, fold=_SAME)
    solid = W.SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = solid[begin]
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(first, out=total[1:], dtype=np.int32)
    return h, starts, ends, total[ends] - total[starts], at


def windows(h: np.ndarray, words: np.ndarray, at: np.ndarray, least: int = WORDS):
    """(first line, end, fingerprint place) of all windows: those from each line on, then those up to each line.

    The fingerprint of a window that ends at a line is the one of the window that begins with its first line.
    """
    n = len(h)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    i = np.arange(n)
    j = np.searchsorted(total, total[:-1] + least)
    j = np.maximum(j, i + 1)
    ok = j <= at[text + 1]
    best = i.copy()
    todo = np.flatnonzero(ok)
    k = 1
    while True:
        todo = todo[i[todo] + k < j[todo]]
        if not len(todo):
            break
        less = h[todo + k] < h[best[todo]]
        best[todo[less]] = todo[less] + k
        k += 1
    e = np.arange(1, n + 1)
    a = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, e - 1)
    back = a >= at[text]
    back &= ok[np.maximum(a, 0)]
    back &= j[np.maximum(a, 0)] != e  # else it is one of the first kind
    return np.concatenate([i[ok], a[back]]), np.concatenate([j[ok], e[back]]), np.concatenate([best[ok], best[a[back]]])


def content(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[a:b]."""
    p, q = W.powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return W.mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64))


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = WORDS) -> DataFrame:
    """(key, h, removed): the numbers of the lines of each document to delete, lines counted without empty ones.

    h is the text's hash. Places are ordered by key (null first), h and line; a window goes
    where its content stood before. Rows that agree in key and text are one document.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = W.utf8(b.column(0))
            h, _, _, words, at = line_table(data, offs)
            _, _, best = windows(h, words, at, least)
            best = np.unique(best)
            return pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), _lists(h.view(np.int64), at, pa.int64()), _lists(words, at, pa.int32()), _lists(h[best].view(np.int64), np.searchsorted(best, at), pa.int64())],
                names=["key", "h", "lines", "words", "prints"],
            )

        return one

    keyed = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    lines = W.per_text(keyed, ["t", "k", "h"], make, f"key {kind}, h long, lines array<bigint>, words array<int>, prints array<bigint>")
    lines = written(lines.where(F.size("prints") > 0), "lines")

    # a fingerprint counts where it stands at two places; those of repeated rows only let more through
    shared = lines.select(F.explode("prints").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    shared = written(shared, "shared")
    shared_ = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared

    def spread(batches):
        for b in batches:
            lists, counts = b.column(2), b.column(3)
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
            h = np.asarray(lists.flatten()).view(np.uint64)
            x, y, best = windows(h, np.asarray(counts.flatten()), at, least)
            doc = np.searchsorted(at, x, "right") - 1
            t = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(t), b.column(1).take(t), pa.array(content(h, x, y).view(np.int64)), pa.array(h[best].view(np.int64)), pa.array((x - at[doc]).astype(np.int32)), pa.array((y - x).astype(np.int32))],
                names=["key", "h", "w", "f", "a", "n"],
            )

    tuned(docs.sparkSession)
    places = lines.select("key", "h", "lines", "words").mapInArrow(spread, f"key {kind}, h long, w long, f long, a int, n int")
    places = written(places.join(shared_, "f", "left_semi").select("key", "h", "w", "a", "n"), "places")
    place = F.struct(F.col("key").isNotNull().alias("some"), F.col("key").alias("k"), "h", "a")
    first = places.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("w", "first")
    later = places.join(first, "w").where(place > F.col("first"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)))))
    out = written(later.groupBy("key", "h").agg(gone.alias("removed")), "removed")
    for t in (lines, shared, places):
        dropped(t)
    return out


def without(column: pa.Array, removed: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without their removed lines (each with the line end after it, the last line with the one before), lines and lines removed."""
    data, offs = W.utf8(column)
    _, starts, ends, at = W.tokenize(data, offs, _NOT_END, fold=_SAME)
    gone, texts = removed.to_pylist(), column.to_pylist()
    for k, numbers in enumerate(gone):
        if not numbers:
            continue
        raw, keep, lo, first = data[offs[k] : offs[k + 1]].tobytes(), [], 0, int(offs[k])
        for i in numbers:
            keep.append(raw[lo : int(starts[at[k] + i]) - first])
            lo = min(int(ends[at[k] + i]) - first + 1, len(raw))
        out = b"".join([*keep, raw[lo:]])
        if raw[-1:] != b"\n" and numbers[-1] == at[k + 1] - at[k] - 1 and out[-1:] == b"\n":
            out = out[:-1]
        texts[k] = out.decode()
    return pa.array(texts, column.type), np.diff(at), np.array([len(x or ()) for x in gone], np.int64)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = WORDS, counts: bool = False) -> DataFrame:
    """The documents, ``text`` without lines of runs that occurred before; with ``counts`` (key, n_lines, n_removed, text) instead.

    A line goes if it lies in a run of neighbouring lines (empty ones don't count) with at
    least ``least`` words that stands whole at an earlier place: in a document of smaller
    key (null is smallest; of equal keys the smaller text hash), or further up in its own.
    The first place stays. Null and empty texts stay; a text all of whose lines go becomes
    empty; rows that repeat key and text lose the same lines; every row stays, in all
    columns, whatever their names; an empty table stays empty. Lines of any length count whole.
    """
    gone = repeated(docs, key, text, least).toDF("_k", "_h", "_removed")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, k = docs.columns.index(text), docs.columns.index(key)
    plain = docs.toDF(*names)
    # one shuffle of the texts by unique keys; the deletions are the hashed side
    joined = plain.withColumn("_h2", F.xxhash64(names[at])).join(gone.hint("shuffle_hash"), F.expr(f"{names[k]} <=> _k AND _h2 = _h"), "left").select(*names, "_removed")

    def run(batches):
        for b in W.chunks(batches, at):
            texts, n, less = without(b.column(at), b.column(len(names)))
            if counts:
                yield pa.RecordBatch.from_arrays([b.column(k), pa.array(n), pa.array(less), texts], names=["c0", "c1", "c2", "c3"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 : len(names)]], names=names)

    if counts:
        kinds = f"c0 {docs.schema[key].dataType.simpleString()}, c1 long, c2 long, c3 string"
        return joined.mapInArrow(run, kinds).toDF(key, "n_lines", "n_removed", text)
    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)
