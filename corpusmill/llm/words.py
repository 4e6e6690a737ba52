"""Words of texts and their 64-bit hashes, computed over whole Arrow batches with numpy."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words of ASCII digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: bytes that are not ASCII white space
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of text that are handled at once, about; a longer text is one chunk, but its words are found piece by piece.
CHUNK_BYTES = 2 << 20
PIECE_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n + 1:
        size = max(n, PIECE_BYTES + 4096) + 1
        for name, base in (("p", _P), ("q", _INV)):
            x = np.full(size, base, _U)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=_U)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit scrambling (the splitmix64 finaliser)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    arr = arr.cast(pa.large_binary() if wide else pa.binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in ``column`` each, a whole row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _cut(data: np.ndarray, at: int, kept: np.ndarray) -> int:
    """The first place from ``at`` on that is outside words."""
    while at < len(data):
        off = np.flatnonzero(~kept[data[at : at + 4096]])
        if len(off):
            return at + int(off[0])
        at += 4096
    return len(data)


def tokenize(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, stem: int = 0, fold: np.ndarray = LOWER) -> tuple[np.ndarray, ...]:
    """Words are runs of bytes in ``kept`` after ``fold`` (A-Z become a-z); they never cross a text's end.

    Returns 64-bit hashes, starts and ends (byte places in ``data``) and the word
    offsets of the texts. Hashes are of a word's lower-cased bytes alone. With ``stem``,
    a fifth array has the hashes of the words' first ``stem`` bytes.
    """
    out, lo = [], 0
    while lo < len(data):
        hi = len(data) if lo + PIECE_BYTES >= len(data) else _cut(data, lo + PIECE_BYTES, kept[fold])
        d = fold[data[lo:hi]]
        mask = kept[d]
        n = len(d)
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        first[inner] = mask[inner]
        last[inner - 1] = mask[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, q = _powers(n)
        total = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[d] * p[:n], out=total[1:])
        row = ((total[ends] - total[starts]) * q[starts], starts + lo, ends + lo)
        out.append((*row, (total[np.minimum(ends, starts + stem)] - total[starts]) * q[starts]) if stem else row)
        lo = hi
    if not out:
        none = np.zeros(0, np.int64)
        return (none.astype(_U), none, none, np.zeros(len(offsets), np.int64), *([none.astype(_U)] if stem else []))
    h, starts, ends, *rest = (np.concatenate(x) for x in zip(*out))
    return (mix(h), starts, ends, np.searchsorted(starts, offsets), *map(mix, rest))


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` neighbours in ``h``."""
    if len(h) < n:
        return np.zeros(0, _U)
    m = len(h) - n + 1
    acc = mix(h[:m], n)
    for k in range(1, n):
        acc = mix(acc * _U(_P) + h[k : k + m], k)
    return acc


def release() -> None:
    """Give freed memory of this worker back to the system: idle workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps what it has
        pass


def per_text(docs: DataFrame, columns: list[str], make: Callable, schema) -> DataFrame:
    """Apply ``make()(batch)``, with the text first in ``columns``, to chunks of rows: one narrow pass, no shuffle."""
    from pyspark.sql import functions as F

    from corpusmill.session import tuned

    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        try:
            for b in chunks(batches, 0):
                yield one(b)
        finally:
            del one
            release()

    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, ``n`` + 1 at least."""
    return _powers(n)
