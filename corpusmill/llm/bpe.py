"""Byte-level BPE encoding and decoding by a public rank file.

Texts are split by the tokenizer's pattern in the JVM. Rows are then packed
into blocks of bounded size; each distinct word of a block is one byte array,
and Spark higher-order functions fold its ranked merges, looking ranks up in a
map from pairs of ids to ids that comes with the block. A word that is a token itself is taken as it is, as
the library does. A task folds a word once: later blocks of
the task refer to it. Nothing is shuffled, joined or broadcast, so cost is
linear in the text at every size. Decoding concatenates the binary
pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import words as W
from corpusmill.session import tuned

_SPACE = r"\t-\r\x{85}\p{Z}"

#: The usual split of byte-level BPE; \s is spelled out as Unicode white space, which Java's \s isn't.
JAVA_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

#: Words of more bytes are merged by a heap in O(n log n): a fold over the whole array for each merge would be quadratic in them.
FOLD_BYTES = 256

#: Pieces in a block at most (a document is never split).
BLOCK_PIECES = 1 << 18

#: Distinct words, and bytes of them, that a task remembers at most; then it starts anew.
KNOWN_WORDS = 1 << 19
KNOWN_BYTES = 12 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """All pairs of ids whose bytes together are a token."""
    out = {}
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a = ranks.get(token[:cut])
            if a is not None and (b := ranks.get(token[cut:])) is not None:
                out[a, b] = r
    return out


@lru_cache(maxsize=4)
def rank_map(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair map as three arrays, by row displacement: pair (a, b) has its slot at base[a] + b, taken only if owner[slot] = a; rank[slot] is the merged id."""
    ranks = load_ranks(path)
    pairs = pair_ranks(ranks)
    if not pairs:
        return np.zeros(max(ranks.values()) + 1, np.int32), np.full(1, -1, np.int32), np.zeros(1, np.int32)
    a, b = np.array(list(pairs), np.int64).T
    r = np.fromiter(pairs.values(), np.int32, len(pairs))
    order = np.lexsort((b, a))
    a, b, r = a[order], b[order], r[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    count = np.diff(np.r_[first, len(a)])
    pad = int(max(ranks.values())) + 1
    taken = np.zeros(3 * len(a) + pad, bool)
    slot, draw = np.zeros(len(a), np.int64), np.random.default_rng(0)
    for i in np.argsort(-count, kind="stable"):
        f, n = first[i], count[i]
        if n == 1:
            break
        bs = b[f : f + n] - b[f]
        while True:
            cand = draw.integers(0, len(taken) - bs[-1], 64)
            fits = np.flatnonzero(~taken[cand[:, None] + bs].any(1))
            if len(fits):
                break
        slot[f : f + n] = cand[fits[0]] + bs
        taken[slot[f : f + n]] = True
    one = first[count == 1]
    slot[one] = np.flatnonzero(~taken)[: len(one)]
    low = int(slot.min())
    slot -= low
    base, owner, rank = np.zeros(pad, np.int32), np.full(int(slot.max()) + 1, -1, np.int32), np.zeros(int(slot.max()) + 1, np.int32)
    base[a[first]] = slot[first] - b[first]
    owner[slot], rank[slot] = a, r
    return base, owner, rank


def _literal(x: np.ndarray, kind: str = "int") -> Column:
    """An array that constant folding turns into one literal."""
    return F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast(f"array<{kind}>")


def packed(owner: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Owner and rank of each slot in one number, and the bits of the rank."""
    bits = int(max(owner.max(), rank.max()) + 1).bit_length()  # all ones, an empty slot, is no id
    both = np.where(owner < 0, -1, owner.astype(np.int64) << bits | rank)
    return (both if bits > 16 else both.astype(np.int32)), bits


class _Codes:
    """The numbers that the fold works on: rank of the pair to the right, place in the word and id of a piece in one bigint.

    A word of at most ``longest`` bytes has as its state the code of each piece, between two of ``end``, an id that no pair has. The least
    code is the leftmost pair of the lowest rank. A rank is an id, the one that the pair merges into;
    pairs that don't merge have ``1 << bits`` or more. ``base`` and ``table`` have the lookup of
    ``rank_map`` with room at both ends, so that no slot lies outside.
    """

    def __init__(self, lookup: tuple[np.ndarray, np.ndarray, np.ndarray], longest: int = FOLD_BYTES):
        base, owner, rank = lookup
        self.end = len(base)
        # the bits have room for ``end`` too, so that no id looks like another or like an empty slot
        both, self.bits = packed(np.append(owner, -1), np.append(rank, self.end))
        self.id_bits = self.end.bit_length()
        self.place_bits = longest.bit_length()
        self.shift = self.id_bits + self.place_bits
        if self.bits + self.shift > 61:
            raise ValueError("too many tokens for the fold's codes")
        low = max(0, -int(base.min()))
        self.base = np.append(base + low, 0).astype(np.int32)
        self.table = np.full(max(int(self.base.max()) + self.end + 1, low + len(both)), -1, both.dtype)
        self.table[low : low + len(both)] = both
        self.none = np.int64(1 << self.bits)

    def states(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and codes of words that ``offs`` cuts out of ``ids``, made for a few thousand words at a time to need little memory."""
        n = len(offs) - 1
        out = offs.astype(np.int64) + 2 * np.arange(n + 1)
        codes = np.empty(int(out[-1]), np.int64)
        for lo in range(0, n, 4096):
            hi = min(n, lo + 4096)
            codes[out[lo] : out[hi]] = self._some(ids[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        return out.astype(np.int32), codes

    def _some(self, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, lens = len(offs) - 1, np.diff(offs)
        at = np.arange(len(ids)) + 2 * np.repeat(np.arange(n), lens) + 1
        flat = np.full(len(ids) + 2 * n, self.end, np.int64)
        flat[at] = ids
        place = np.zeros(len(flat), np.int64)
        place[at] = np.minimum(np.arange(len(ids)) - np.repeat(offs[:-1], lens) + 1, (1 << self.place_bits) - 1)
        rank = np.full(len(flat), self.none)
        found = self.table[self.base[flat[:-1]] + flat[1:]].astype(np.int64)
        if self.table.dtype == np.int32:
            found &= 0xFFFFFFFF
        rank[:-1] = np.where(found >> self.bits == flat[:-1], found & (int(self.none) - 1), self.none)
        return rank << self.shift | place << self.id_bits | flat

    def ids(self, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the words in folded states."""
        inner = np.ones(len(codes), bool)
        inner[offs[:-1]] = inner[offs[1:] - 1] = False
        return (offs - 2 * np.arange(len(offs))).astype(np.int32), (codes[inner] & ((1 << self.id_bits) - 1)).astype(np.int32)


@lru_cache(maxsize=4)
def codes(path: str, longest: int = FOLD_BYTES) -> _Codes:
    return _Codes(rank_map(path), longest)


def _with(x: Column, use) -> Column:
    """``use`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def fold_column(states: Column, c: _Codes, base: Column, table: Column) -> Column:
    """Merge every state (see ``_Codes``) in ``states`` (array<array<bigint>>).

    One step replaces the leftmost pair of the lowest rank, and looks up its two new neighbours.
    """
    low, place = (1 << c.id_bits) - 1, (1 << c.shift) - (1 << c.id_bits)
    narrow = c.table.dtype == np.int32
    most = F.lit(int(c.none) << c.shift).cast("bigint")

    def rank(a: Column, b: Column) -> Column:
        """The code's part of the pair of two ids (int)."""
        found = F.get(table, F.get(base, a) + b)
        if narrow:
            found = F.shiftleft(a, c.bits).bitwiseXOR(found).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
        else:
            found = F.shiftleft(a.cast("bigint"), c.bits).bitwiseXOR(found).bitwiseAND(F.lit((1 << 2 * c.bits) - 1))
        if 2 * c.bits + c.shift > 62:
            found = F.least(found, F.lit(int(c.none)).cast("bigint"))
        return F.shiftleft(found, c.shift)

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low).cast("bigint")).cast("int")

    def merged(s: Column, least: Column, at: Column) -> Column:
        left = F.get(s, at - 2)

        def pair(new: Column) -> Column:
            return F.array(
                rank(id_of(left), new).bitwiseOR(left.bitwiseAND(F.lit(low | place).cast("bigint"))),
                rank(new, id_of(F.get(s, at + 1))).bitwiseOR(least.bitwiseAND(F.lit(place).cast("bigint"))).bitwiseOR(new.cast("bigint")),
            )

        new = F.shiftright(least, c.shift).cast("int")
        return F.concat(F.slice(s, F.lit(1), at - 2), pair(new), F.slice(s, at + 2, F.size(s)))

    def step(s: Column, _: Column) -> Column:
        return _with(F.array_min(s), lambda least: F.when(least >= most, s).otherwise(_with(F.array_position(s, least).cast("int"), lambda at: merged(s, least, at))))

    def fold(s: Column) -> Column:
        # a word of n pieces has n - 1 merges at most
        return F.when(F.array_min(s) >= most, s).otherwise(F.aggregate(F.slice(s, F.lit(4), F.size(s)), s, step))

    return F.transform(states, fold)


def merge_column(words: Column, path: str) -> Column:
    """Merge every array of up to 2^24 byte ids in ``words`` (array<array<int>>), with the ranks as literals, which the driver holds as text in each plan and event."""
    c = codes(path, 1 << 24)
    base, table = _literal(c.base), _literal(c.table, "bigint" if c.table.dtype == np.int64 else "int")
    low = F.lit((1 << c.id_bits) - 1).cast("bigint")

    def state(w: Column) -> Column:
        ids = F.concat(F.array(F.lit(c.end)), w, F.array(F.lit(c.end)))

        def code(a: Column, i: Column) -> Column:
            found = F.get(table, F.get(base, a) + F.get(ids, i + 1))
            hit = F.shiftrightunsigned(found, c.bits) == a
            rank = F.when(hit, found.bitwiseAND(int(c.none) - 1)).otherwise(int(c.none)).cast("bigint")
            return F.shiftleft(rank, c.shift).bitwiseOR(F.shiftleft(F.least(i, F.lit((1 << c.place_bits) - 1)).cast("bigint"), c.id_bits)).bitwiseOR(a.cast("bigint"))

        return F.transform(ids, code)

    folded = fold_column(F.transform(words, state), c, base, table)
    return F.transform(folded, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(low).cast("int")))


def heap_merge(ids: list[int], lookup: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    """The same merges for one long word: a heap of pairs over a linked list."""
    base, owner, rank = lookup
    n, size = len(ids), len(owner)

    def pair(a: int, b: int) -> int | None:
        s = int(base[a]) + b
        return int(rank[s]) if 0 <= s < size and owner[s] == a else None

    ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (q := pair(r, ids[k])) is not None:
                heapq.heappush(heap, (q, i, r, ids[k]))
        if (p := prv[i]) >= 0 and (q := pair(ids[p], r)) is not None:
            heapq.heappush(heap, (q, p, ids[p], r))
    return [x for x in ids if x >= 0]


_BLOCK = "payload binary, codes binary, ends binary, fresh boolean, words array<array<bigint>>, base array<int>, pairs array<{}>"


def _blocks(byte_ids: np.ndarray, lookup: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: list[bytes], c: _Codes):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.array(tokens, pa.binary())
        known = pa.array([], pa.binary())
        table = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (c.base, c.table)]
        for b in batches:
            at = b.schema.get_field_index("_pieces")
            lists = b.column(at)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
            rest = b.drop_columns(["_pieces"])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_PIECES, "right")) - 1)
                flat = lists.slice(lo, hi - lo).flatten()
                enc = pc.dictionary_encode(flat.cast(pa.binary()))
                fresh = len(known) > KNOWN_WORDS or known.nbytes > KNOWN_BYTES
                if fresh:
                    known = pa.array([], pa.binary())
                place = pc.index_in(enc.dictionary, value_set=known)
                words = enc.dictionary.filter(pc.is_null(place))
                place = np.array(pc.fill_null(place, -1), dtype=np.int32)
                place[place < 0] = len(known) + np.arange(len(words), dtype=np.int32)
                known = pa.concat_arrays([known, words])
                _, offs, data = words.buffers()
                offs = np.frombuffer(offs, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
                vals = byte_ids[np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]] if len(words) else np.zeros(0, np.int32)
                offs = offs - offs[0]
                lens = np.diff(offs)
                # a word that is a token needs no merge; of the ids of its bytes one place is kept, for the token
                token = np.array(pc.fill_null(pc.index_in(words, value_set=whole), -1), dtype=np.int32)
                hit = np.flatnonzero(token >= 0)
                if len(hit):
                    stay = np.repeat(token < 0, lens)
                    stay[offs[hit]] = True
                    vals = vals.copy()
                    vals[offs[hit]] = token[hit]
                    vals, lens = vals[stay], np.where(token >= 0, 1, lens)
                    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                if len(lens) and lens.max() > FOLD_BYTES:
                    parts = np.split(vals, offs[1:-1])
                    for i in np.flatnonzero(lens > FOLD_BYTES):
                        parts[i] = np.array(heap_merge(parts[i].tolist(), lookup), np.int32)
                    vals, offs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                inner = pa.ListArray.from_arrays(*map(pa.array, c.states(vals, offs)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as w:
                    w.write_batch(rest.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        pa.array([place[np.asarray(enc.indices)].tobytes()], pa.binary()),
                        pa.array([(ends[lo + 1 : hi + 1] - ends[lo]).tobytes()], pa.binary()),
                        pa.array([fresh]),
                        pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner),
                        *table,
                    ],
                    names=["payload", "codes", "ends", "fresh", "words", "base", "pairs"],
                )
                lo = hi
        del known
        W.release()

    return pack


def _finish(digests: bool, with_ids: bool, pieces: list[bytes], names: list[str], c: _Codes):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces, pa.large_binary()) if digests else None
        words = pa.array([], pa.list_(pa.int32()))
        for b in batches:
            for k in range(b.num_rows):
                rest = pa.ipc.open_stream(b.column(0)[k].as_buffer()).read_all().combine_chunks()
                codes = np.frombuffer(b.column(1)[k].as_buffer(), np.int32)
                ends = np.concatenate([[0], np.frombuffer(b.column(2)[k].as_buffer(), np.int64)])
                new = b.column(4)[k].values
                new = pa.ListArray.from_arrays(*map(pa.array, c.ids(np.asarray(new.flatten()), np.asarray(pc.subtract(new.offsets, new.offsets[0])))))
                words = new if b.column(3)[k].as_py() else pa.concat_arrays([words, new])
                lens = np.asarray(pc.list_value_length(words), dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(lens[codes])])[ends]
                ids = words.take(pa.array(codes)).flatten() if len(codes) else pa.array([], pa.int32())
                cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
                cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
                if digests:
                    raw = np.asarray(ids, dtype="<u4").tobytes()
                    text = table.take(ids)
                    o = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
                    data = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
                    cut = o[at]
                    sha = hashlib.sha256
                    cols += [
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([sha(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:])], pa.string()),
                        pa.array([sha(data[x:y]).hexdigest() for x, y in zip(cut, cut[1:])], pa.string()),
                    ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del words, table
        W.release()

    return unpack


def _run(docs: DataFrame, text: str, path: str, keep: list[str], digests: bool, out: list[T.StructField], with_ids: bool = False) -> DataFrame:
    tuned(docs.sparkSession)
    ranks = load_ranks(path)
    byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    kept = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(JAVA_PATTERN), 0).alias("_pieces"))
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        pieces[r] = token
    c = codes(path)
    blocks = kept.mapInArrow(_blocks(byte_ids, rank_map(path), pieces, c), _BLOCK.format("bigint" if c.table.dtype == np.int64 else "int"))
    merged = blocks.select("payload", "codes", "ends", "fresh", fold_column(F.col("words"), c, F.col("base"), F.col("pairs")).alias("words"))
    schema = T.StructType([docs.schema[c] for c in keep] + out)
    return merged.mapInArrow(_finish(digests, with_ids or not digests, pieces if digests else [], schema.fieldNames(), c), schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids``: array<int>, as a byte-level BPE library encodes without special tokens.

    A null text counts as empty and an empty text has no ids; repeated rows stay
    repeated; an empty table gives an empty table; a column that is named as ``ids``
    (in any case) is replaced. Long texts stay whole (a block holds at least one document), and a
    word beyond FOLD_BYTES bytes is merged by a heap, with the same result.
    """
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    return _run(docs, text, path, keep, False, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the binary concatenation of the ids' pieces, in the JVM. Null ids give null, none give empty bytes; a null, negative or unknown id fails, in every mode of SQL."""
    ranks = load_ranks(path)
    by_id = [""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        by_id[r] = token.hex()
    pieces = F.split(F.lit(",".join(by_id)), ",")

    def piece(i: Column) -> Column:
        found = F.when((i >= 0) & (i < len(by_id)), F.get(pieces, i))
        return F.when(found.isNull() | (found == ""), F.raise_error(F.concat(F.lit("no token has id "), F.coalesce(i.cast("string"), F.lit("null"))))).otherwise(found)

    return df.withColumn(out, F.unhex(F.array_join(F.transform(F.col(f"`{ids}`"), piece), "")))


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256 (bytes that the ids decode to).

    Nulls, empty and long texts, repeated rows and empty tables as in ``encode``; other columns aren't looked at.
    """
    return _run(docs, text, path, [key], True, _DIGESTS)


def encode_checked(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``encode`` with the columns of ``digests`` before the ids; columns of those names (in any case) are replaced."""
    new = [*_DIGESTS, T.StructField(ids, T.ArrayType(T.IntegerType()))]
    taken = {text.lower(), *(f.name.lower() for f in new)}
    return _run(docs, text, path, [c for c in docs.columns if c.lower() not in taken], True, new, True)
