"""Approximate nearest neighbours by inner product: collision counting over single projections.

Vectors x become (x, sqrt(M^2 - |x|^2)), queries q become (q, 0), M the largest norm:
then the largest inner product is the smallest distance. Each of PROJECTIONS random
projections has a sorted array of a block's vectors. A query-centred window grows in each
array by virtual rehashing (radius R, then larger ones); a vector whose projection lies
within the windows of at least ``threshold`` arrays is verified by its exact inner
product. A vector at a distance of at most R passes with probability 1 - MISS at least,
so growth ends when the K-th best verified vector is no further than R. Nothing caps
candidates.

Data and queries are dealt into blocks; each pair of a data and a query block is one
task of bounded size (a stated query set, in blocks, against all rows). The best of each
block are merged by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written

K = 20
PROJECTIONS = 48
#: Half the width of a window, in units of R.
HALF = 1.0
#: Chance that a vector within R fails the collision threshold.
MISS = 0.04
GROWTH = 1.5
#: Vectors and queries of a block.
DATA_BLOCK, QUERY_BLOCK = 8192, 8192
EVERY = 20


def threshold(m: int = PROJECTIONS, half: float = HALF, miss: float = MISS) -> int:
    """The most collisions that a vector at distance R reaches with probability 1 - miss."""
    p = math.erf(half / math.sqrt(2))
    below = 0.0
    for l in range(m + 1):
        below += math.comb(m, l) * p**l * (1 - p) ** (m - l)
        if below > miss:
            return l
    return m


def search(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray, top: float, k: int = K, seed: int = 7):
    """For each query the places of at least the k nearest found of a block and their inner products.

    ``rows`` and ``own`` name rows: a query doesn't find its own row. ``top`` is the
    largest norm M of all vectors.
    """
    d = x.shape[1]
    r = np.random.default_rng(seed).normal(size=(d + 1, PROJECTIONS))
    lift = np.sqrt(np.maximum(0, top * top - np.einsum("ij,ij->i", x, x)))
    hx, hq = x @ r[:d] + lift[:, None] * r[d], q @ r[:d]
    n, need = len(x), threshold()
    order = np.argsort(hx, 0, kind="stable")
    arrays = np.take_along_axis(hx, order, 0).T.copy()  # one sorted array per projection
    rank = np.empty((PROJECTIONS, n), np.uint16 if n < 65536 else np.uint32)  # place of each vector in each array
    for j in range(PROJECTIONS):
        rank[j, order[:, j]] = np.arange(n)
    kind = rank.dtype
    qq = np.einsum("ij,ij->i", q, q)
    distance = lambda i, score: np.sqrt(np.maximum(0, top * top + qq[i] - 2 * score)) * (1 + 1e-9)
    # begin a little below the least distance to a few vectors: a larger start costs candidates, never results
    radius = np.maximum(distance(slice(None), (q @ x[:64].T).max(1)) * 0.75, 1e-9 * (top or 1))
    last = 4 * top + 4 * float(np.sqrt(qq.max(initial=0)))  # beyond every distance
    total = n - np.isin(own, rows)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        lo, wide = np.empty((2, len(todo), PROJECTIONS), kind)
        for j in range(PROJECTIONS):
            half = HALF * radius[todo]
            a = np.searchsorted(arrays[j], hq[todo, j] - half)
            lo[:, j], wide[:, j] = np.minimum(a, n), np.searchsorted(arrays[j], hq[todo, j] + half, "right") - a
        again = []
        for t, i in enumerate(todo.tolist()):
            inside = (rank - lo[t][:, None]) < wide[t][:, None]  # unsigned: places below lo wrap round
            found = np.flatnonzero(np.add.reduce(inside, axis=0, dtype=np.uint8) >= need)
            found = found[rows[found] != own[i]]
            least = min(k, int(total[i]))
            if len(found) < least and radius[i] <= last:
                radius[i] *= GROWTH
                again.append(i)
                continue
            if radius[i] > last:
                found = np.flatnonzero(rows != own[i])
            score = x[found] @ q[i] if 8 * len(found) < n else (x @ q[i])[found]
            kth = np.partition(score, len(score) - least)[len(score) - least]
            far = float(distance(i, kth))
            if far <= radius[i] or radius[i] > last:
                near = found[score >= kth - 1e-9 * (1 + abs(kth))]
                exact = np.add.reduce(x[near] * q[i], axis=1)  # the same order of addition for every vector
                best = np.lexsort((ids[near], -exact))[:k]
                yield i, near[best], exact[best]
            else:
                radius[i] = far
                again.append(i)
        todo = np.array(again, np.int64)


def _matrix(col, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(x.as_buffer() for x in col), np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest by inner product of every row whose key is divisible by ``every``: query_id, rank, vec_id, score.

    Scores are exact, in double precision, ties go to the smaller key. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do null keys or vectors of another
    length than most have. Repeated rows are rows of their own: each finds the others, and a repeated
    query key gives rows for each. Fewer candidates than k give as many rows; an empty table gives none.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    # written once: row numbers are then the same whenever a task is repeated
    stored = written(usable.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kinds = stored.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.count(F.when(F.pmod("id", F.lit(every)) == 0, 1)).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not kinds or not kinds[0].q:
        return vectors.sparkSession.createDataFrame([], schema)
    d, top = kinds[0].d, math.sqrt(kinds[0].top)
    parts, asks = -(-kinds[0].n // DATA_BLOCK), -(-kinds[0].q // QUERY_BLOCK)

    def pack(batches):
        for b in batches:
            flat = np.asarray(b.column(2).flatten(), dtype="<f8")
            rows = [flat[i * d : (i + 1) * d].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["id", "row", "raw"])

    packed = stored.where(F.col("d") == d).select("id", "row", "v").mapInArrow(pack, "id long, row long, raw binary")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    data = packed.withColumn("p", deal(parts)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    query = packed.where(F.pmod("id", F.lit(every)) == 0).withColumn("a", deal(asks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, rows = np.asarray(left.column("id")), np.asarray(left.column("row"))
            qid, own = np.asarray(right.column("id")), np.asarray(right.column("row"))
            x, q = _matrix(left.column("raw"), d), _matrix(right.column("raw"), d)
            for i, at, score in search(x, ids, rows, q, own, top, k):
                out.append((np.full(len(at), own[i]), np.full(len(at), qid[i]), ids[at], score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"own": cols[0], "query_id": cols[1], "vec_id": cols[2], "score": cols[3]})

    found = data.groupBy("p", "a").cogroup(query.groupBy("p", "a")).applyInArrow(pair, "own long, query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("own", "query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("i", "b"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
