"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items make one automaton (a state per class of
substrings, suffix links, transitions by word). Each document's words stream
through it; the length of the longest match that ends at a word tells whether
the last ``window`` words are consecutive words of an item. Before that, a
filter drops what can't match: every neighbouring pair of words within a window
is a neighbouring pair of an item, so only runs of such pairs are streamed. It
keeps every match.

Benchmarks are small next to a corpus; all the same their size is checked: items
are dealt into parts of at most PART_WORDS words, each of which makes an automaton of
its own. One part (the usual case) is one narrow pass over the documents, without any
shuffle; several are passes whose results are merged by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import words as W
from corpusmill.session import tuned

#: Consecutive words that count as a leak; shorter items count whole.
WINDOW = 10

#: Words of benchmark in one automaton at most (about 1 KB of memory a word).
PART_WORDS = 100_000

#: Documents with at least this share of hit words go; of others the hit spans go.
COVERAGE = 0.5

_SLOTS = 1 << 20


class Automaton:
    """A generalised suffix automaton over word ids; states hold which items own their windows."""

    def __init__(self, items: list[np.ndarray], window: int):
        self.window = window
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.owner: list[set[int]] = [set()]  # items of which the state's window of ``window`` words is a part
        self.whole: dict[int, set[int]] = {}  # state -> items shorter than a window that it spells
        pairs = []
        coded = [np.searchsorted(self.vocab, x) for x in items]
        for x in coded:
            last = 0
            for c in x.tolist():
                last = self._extend(last, c)
            pairs.append(x[:-1] * len(self.vocab) + x[1:])
        for n, x in enumerate(coded):
            state = 0
            for c in x.tolist():
                state = self.next[state][c]
                s = state
                while s > 0 and self.len[s] >= window and n not in self.owner[s]:
                    self.owner[s].add(n)
                    s = self.link[s]
            if 0 < len(x) < window:
                self.whole.setdefault(state, set()).add(n)
        self.shortest = min([window, *(len(x) for x in coded if len(x))])
        self.pair = np.zeros(_SLOTS, bool)
        self.pair[self._slot(np.concatenate([np.zeros(0, np.int64), *pairs]))] = True
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (W.mix(pair.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(to)
        self.owner.append(set())
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest string of ``p`` followed by c, split off if need be."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.known[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), max(len(self.vocab) - 1, 0))
        hit = self.vocab[at] == h[maybe] if len(self.vocab) else np.zeros(len(maybe), bool)
        out[maybe[hit]] = at[hit]
        return out

    def match(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items found in each text."""
        n = len(h)
        hits, found = np.zeros(n + 1, np.int32), {}
        if not n or not len(self.vocab):
            return np.zeros(n, bool), found
        ids = self.ids(h)
        good = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(good)
        good[at] = self.pair[self._slot(ids[at] * len(self.vocab) + ids[at + 1])]
        inner = offsets[(offsets > 0) & (offsets < n)]
        good[inner - 1] = False
        # runs of words a..b (exclusive), joined by good pairs
        if self.shortest > 1:
            edge = np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            cut = np.concatenate([[0], np.flatnonzero(~good) + 1, [n]])
            a, b = cut[:-1], cut[1:]
        long = b - a >= self.shortest
        for lo, hi in zip(a[long].tolist(), b[long].tolist()):
            text = int(np.searchsorted(offsets, lo, "right")) - 1
            for i, k, items in self._stream(ids[lo:hi].tolist()):
                hits[lo + i + 1 - k] += 1
                hits[lo + i + 1] -= 1
                found.setdefault(text, set()).update(items)
        return np.cumsum(hits[:n]) > 0, found

    def _stream(self, ids: list[int]):
        """(place of the last word, words, items) of each window that occurs."""
        nxt, link, length, w, whole = self.next, self.link, self.len, self.window, self.whole
        s = n = 0
        for i, c in enumerate(ids):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            else:
                s = n = 0
            if n >= w:
                x = s
                while length[link[x]] >= w:
                    x = link[x]
                yield i, w, self.owner[x]
            if whole:
                x = s
                while x > 0:
                    if x in whole and length[x] <= n:
                        yield i, length[x], whole[x]
                    x = link[x]


def automata(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", part_words: int = PART_WORDS) -> list[tuple[Automaton, list[str | None]]]:
    """Automata of all items with their keys as strings, each of a bounded part of the items; at least one, if empty."""
    parts, held, names, size = [], [], [], 0
    rows = items.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"))
    for r in rows.toLocalIterator():
        raw = np.frombuffer((r.t or "").encode(), np.uint8)
        h = W.tokenize(raw, np.array([0, len(raw)]), W.ALNUM)[0]
        if held and size + len(h) > part_words:
            parts.append((Automaton(held, window), names))
            held, names, size = [], [], 0
        held.append(h)
        names.append(r.k)
        size += len(h)
    return [*parts, (Automaton(held, window), names)]


def _sha(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and aren't contaminated; repeated rows get a row
    each; an empty table gives an empty table; without items nothing is hit. Items that
    are null, empty or without words never occur, items of one text all do, and an item
    whose key is null hits words but isn't counted or listed. Texts are streamed whole.
    With several parts, rows are told apart by key and text, and repeats of both merge
    into as many equal rows.
    """
    parts = automata(items, window, part_words=part_words)
    kind = docs.schema[key].dataType.simpleString()
    if len(parts) > 1:
        return _merged(docs, parts, key, text)

    def make():
        auto, names = parts[0]

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offs = W.utf8(b.column(0))
            h, _, _, at = W.tokenize(data, offs, W.ALNUM)
            hit, found = auto.match(h, at)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[at[1:]] - total[at[:-1]]
            keys = [{names[i] for i in found.get(k, ()) if names[i] is not None} for k in range(b.num_rows)]
            none = _sha(set())
            return pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(np.diff(at)), pa.array(n_hit), pa.array([len(x) for x in keys], pa.int64()), pa.array([_sha(x) if x else none for x in keys]), pa.array(n_hit > 0)],
                names=["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

        return one

    out = W.per_text(docs, [text, key], make, f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("key", key)


def _merged(docs: DataFrame, parts: list, key: str, text: str) -> DataFrame:
    """The same for several parts: hit places of each part, united by document."""
    kind = docs.schema[key].dataType.simpleString()
    done = None
    for auto, names in parts:

        def make(auto=auto, names=names):
            def one(b: pa.RecordBatch) -> pa.RecordBatch:
                data, offs = W.utf8(b.column(0))
                h, _, _, at = W.tokenize(data, offs, W.ALNUM)
                hit, found = auto.match(h, at)
                places = [np.flatnonzero(hit[x:y]).tolist() for x, y in zip(at, at[1:])]
                keys = [sorted({names[i] for i in found.get(k, ()) if names[i] is not None}) for k in range(b.num_rows)]
                return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.diff(at)), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.string()))], names=["key", "h", "n_words", "places", "items"])

            return one

        seen = W.per_text(docs.withColumn("_h", F.xxhash64(F.col(f"`{text}`"))), [text, key, "_h"], make, f"key {kind}, h long, n_words long, places array<int>, items array<string>")
        done = seen if done is None else done.unionByName(seen)
    n = len(parts)
    merged = done.groupBy("key", "h").agg(
        (F.count("*") / n).cast("int").alias("copies"), F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    rows = merged.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def spans(text: bytes, parts: list[tuple[Automaton, list[str | None]]]) -> tuple[list[tuple[int, int]], float]:
    """Byte spans of one text that hold hit words, and the share of words that are hit."""
    data = np.frombuffer(text, np.uint8)
    h, starts, ends, at = W.tokenize(data, np.array([0, len(data)]), W.ALNUM)
    hit = np.zeros(len(h), bool)
    for auto, _ in parts:
        hit |= auto.match(h, at)[0]
    return _spans(hit, starts, ends), float(hit.mean()) if len(hit) else 0.0


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return list(zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist()))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The documents with all their columns, hit spans cut out of ``text``.

    A document whose share of hit words reaches ``coverage`` goes altogether. Others
    keep all text outside the spans (from the first to the last hit word of each), so
    a document without hits, a null or an empty text stays as it is. Every row is
    handled alone: repeats stay repeated, other columns aren't looked at.
    """
    tuned(docs.sparkSession)
    parts = automata(items, window)
    column = docs.columns.index(text)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in W.chunks(batches, column):
            data, offs = W.utf8(b.column(column))
            h, starts, ends, at = W.tokenize(data, offs, W.ALNUM)
            hit = np.zeros(len(h), bool)
            for auto, _ in parts:
                hit |= auto.match(h, at)[0]
            if hit.any():
                total = np.concatenate([[0], np.cumsum(hit)])
                n = total[at[1:]] - total[at[:-1]]
                stay = n < coverage * np.maximum(np.diff(at), 1)
                texts = b.column(column).to_pylist()
                for k in np.flatnonzero(stay & (n > 0)):
                    lo, hi = at[k], at[k + 1]
                    raw, at_byte, kept = data[offs[k] : offs[k + 1]].tobytes(), 0, []
                    for x, y in _spans(hit[lo:hi], starts[lo:hi] - offs[k], ends[lo:hi] - offs[k]):
                        kept.append(raw[at_byte:x])
                        at_byte = y
                    texts[k] = b"".join([*kept, raw[at_byte:]]).decode()
                cols = list(b.columns)
                cols[column] = pa.array(texts, b.schema.field(column).type)
                b = pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay))
            yield b

    return docs.mapInArrow(run, schema)


def report_sql(window: int = WINDOW) -> str:
    """The same as DuckDB SQL: windows as joined words, met by equality."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS s
 FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
 FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""
