"""N-gram Jaccard join by a count-vector R-tree.

A document's set holds its distinct 5-word shingles. Equal sets are one class.
Every shingle is hashed to one of GROUPS groups; a class's group counts are a point, and the
sum of the coordinate minima of two points bounds the size of their intersection from
above. Points are packed into an R-tree whose nodes hold the maxima of their coordinates, so
that the same sum bounds all pairs of two nodes; pairs that survive are verified on
the sets themselves.

To spread the trees over tasks without losing a pair: the sets of a pair of Jaccard 0.9
differ in at most (a + b) / 19 shingles, so when both are cut, by ranges of the hash, into one
part more than that, one part at least is equal in both. Classes that share a part are
one tree's points (large groups are dealt into tiles, each pair of which is one tree join;
of groups of the same classes one is enough). A part holds six shingles or more on average, so that
texts rarely share one by chance, however many texts there are. Surviving pairs
give candidate components; the members' sets are brought together once for each component,
again by tiles, and every pair there is bounded and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import words as W
from corpusmill.llm.components import DRIVER_EDGES, components, forest
from corpusmill.session import dropped, swept, written

SHINGLE = 5
PERCENT = 90
GROUPS = 64
LEAF = 16
#: Least sizes of the size classes; all sets of a class, and those of the class below that may be similar to one, are cut into equally many parts.
EDGES = np.array([1, *(int(8 * 1.5**i) for i in range(64))], np.int64)
#: Points of a tile of one part, and shingles of a tile of one component.
TILE_POINTS = 2048
TILE_SHINGLES = 1 << 19
#: Members of candidate components (about 50 bytes each) whose list is broadcast at most; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 18

_U = np.uint64
_SATURATED = 65535  # a count that large stands for any: the bound stays a bound


def shingles(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, in place, and the offsets of the texts."""
    n = np.diff(at)
    size = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], _U)
    long = n >= SHINGLE
    if long.any():
        full = W.chain(h, SHINGLE)
        inside = np.repeat(at[:-1][long] - ends[:-1][long], size[long]) + np.flatnonzero(np.repeat(long, size))
        out[np.repeat(long, size)] = full[inside]
    for k in np.flatnonzero(~long & (n > 0)):
        out[ends[k]] = W.chain(h[at[k] : at[k + 1]], int(n[k]))[0]
    return out, ends


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = W.utf8(column)
    h, _, _, at = W.tokenize(data, offs, W.SOLID)
    return shingles(h, at)


def set_hash(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    p, q = W.powers(len(u))
    with np.errstate(over="ignore"):
        a = (u * p[: len(u)]).sum(dtype=_U)
        b = ((u ^ _U(0x5851F42D4C957F2D)) * q[: len(u)]).sum(dtype=_U)
    x = W.mix(np.array([a, b], _U) + _U(len(u)), 5).view(np.int64)
    return int(x[0]), int(x[1])


def part_keys(u: np.ndarray) -> np.ndarray:
    """One number for each part of a sorted set; similar but different sets have one in common."""
    n = len(u)
    own = int(np.searchsorted(EDGES, n, "right")) - 1
    out = [np.zeros(0, np.int64)]
    if n:
        total = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(u, 7), dtype=_U)])
    # a larger partner may be of the next class
    for c in range(own, own + 1 + (n * 100 // PERCENT >= EDGES[own + 1])) if n else ():
        parts = 2 * (int(EDGES[c + 1]) - 1) * (100 - PERCENT) // (100 + PERCENT) + 1
        if parts > 1:  # else only equal sets are similar
            ends = np.searchsorted((u >> _U(32)) * _U(parts) >> _U(32), np.arange(parts + 1, dtype=_U))
            place = W.mix(np.arange(parts, dtype=_U) + _U(c << 40), 11)
            out.append(W.mix((total[ends[1:]] - total[ends[:-1]]) ^ place, 12).view(np.int64))
    return np.concatenate(out)


def need(a, b):
    """The least intersection of sets of sizes a and b that are similar."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def bounded(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of rows of c and d."""
    return np.minimum(c, d).sum(1, dtype=np.int64)


def pairs(n: np.ndarray, c: np.ndarray, side: np.ndarray | None = None):
    """(i, j) arrays of all points whose sizes and bound allow similarity, by an R-tree of count vectors.

    With ``side`` only pairs of different sides are given. Points are packed in the order of
    their sizes and of their first coordinates; c holds int64 counts.
    """
    order = np.lexsort((c[:, 0], n))
    n, c = n[order], c[order]
    m = len(n)
    leaves = -(-m // LEAF)
    edge = np.minimum(np.arange(leaves + 1) * LEAF, m)
    top = np.maximum.reduceat(c, edge[:-1], 0)
    small, large = n[edge[:-1]], n[edge[1:] - 1]
    out = []
    for x in range(leaves):
        # leaves after x whose sizes can match, then by the bound of the boxes
        last = int(np.searchsorted(small * PERCENT, large[x] * 100, "right"))
        y = np.arange(x, last)
        if len(y) > 1:
            y = y[bounded(top[x][None], top[y]) >= need(small[x], np.maximum(small[y], small[x]))]
        if not len(y):
            continue
        i = np.arange(edge[x], edge[x + 1])
        j = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in y])
        a, b = (z.ravel() for z in np.meshgrid(i, j, indexing="ij"))
        ok = (a < b) & (n[a] * 100 >= n[b] * PERCENT)
        if side is not None:
            ok &= side[order[a]] != side[order[b]]
        a, b = a[ok], b[ok]
        for lo in range(0, len(a), 1 << 15):
            s, t = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            ok = bounded(c[s], c[t]) >= need(n[s], n[t])
            out.append((order[s[ok]], order[t[ok]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _counts(col: pa.Array) -> np.ndarray:
    c = np.frombuffer(b"".join(x.as_buffer() for x in col), np.uint16).reshape(-1, GROUPS).astype(np.int64)
    return np.where(c == _SATURATED, 1 << 40, c)


def _grouped(batches, keys: int):
    """Tables of neighbouring rows that agree in the first ``keys`` columns, across batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(i)) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(k[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c1, c2, n, counts, keys) of every document: class, set size, point, parts."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            h, at = _sets(b.column(0))
            c1, c2, n, counts, keys = [], [], [], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                u = np.unique(h[lo:hi])
                size = len(u)
                x = set_hash(u)
                c1.append(x[0])
                c2.append(x[1])
                n.append(size)
                counts.append(np.minimum(np.bincount((u & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS), _SATURATED).astype(np.uint16).tobytes())
                keys.append(part_keys(u))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            return pa.RecordBatch.from_arrays([b.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary()), lists], names=["key", "c1", "c2", "n", "counts", "keys"])

        return one

    kind = docs.schema[key].dataType.simpleString()
    return W.per_text(docs, [text, key], make, f"key {kind}, c1 long, c2 long, n long, counts binary, keys array<bigint>")


def _adjacent(batches):
    """Of rows sorted by (key, n, cid): those with a neighbour of the same key whose size allows similarity, and a partition's first and last rows, whose neighbours may be elsewhere."""
    held = None
    first, wanted = True, False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*( [held] if held is not None else []), b]).combine_chunks().to_batches()[0] if held is not None else b
        k, n, c = (np.asarray(t.column(i)) for i in range(3))
        near = (k[1:] == k[:-1]) & (n[1:] * PERCENT <= n[:-1] * 100) & (c[1:] != c[:-1])
        keep = np.zeros(len(k), bool)
        keep[1:] |= near
        keep[:-1] |= near
        keep[0] |= first or wanted
        # the last row waits for its successor
        yield t.slice(0, len(k) - 1).filter(pa.array(keep[:-1]))
        held, first, wanted = t.slice(len(k) - 1), False, bool(keep[-1])
    if held is not None:
        yield held


def _candidate_edges(classes: DataFrame, tile: int = TILE_POINTS) -> DataFrame:
    """(u, v) of classes joined by pairs that share a part and survive the R-tree; enough to connect all such pairs."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.where("n > 0").select(F.explode("keys").alias("k"), "n", "cid")
    # ranges over (part, size, class): a part of very many classes is spread over tasks
    near = rows.repartitionByRange(parts, "k", "n", "cid").sortWithinPartitions("k", "n", "cid").mapInArrow(_adjacent, "k long, n long, cid long")
    near = written(near, "near")
    # near copies share most of their parts; of parts of the same classes (by 128 bits) one is joined
    same = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"x{i}") for i in range(2)]
    groups = near.groupBy("k").agg(F.count("*").alias("c"), *same).where("c > 1").groupBy("c", "x0", "x1").agg(F.min("k").alias("k"))
    dealt = near.join(groups.select("k", F.ceil(F.col("c") / tile).cast("int").alias("t")), "k").withColumn("r", F.pmod(F.xxhash64("cid"), "t").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    dealt = dealt.select("k", F.least("r", "o").alias("a"), F.greatest("r", "o").alias("b"), "r", "cid")
    points = dealt.join(classes.select("cid", "n", "counts"), "cid").select("k", "a", "b", "r", "cid", "n", "counts")

    def join(batches):
        for t in _grouped(batches, 3):
            cid = np.asarray(t.column(4))
            cid, at = np.unique(cid, return_index=True)
            if len(cid) < 2:
                continue
            n, c, r = np.asarray(t.column(5))[at], _counts(t.column(6).combine_chunks().take(pa.array(at))), np.asarray(t.column(3))[at]
            i, j = pairs(n, c, r if t.column(1)[0] != t.column(2)[0] else None)
            if len(i):
                m, root = forest(cid[i], cid[j])
                keep = m != root
                yield pa.RecordBatch.from_arrays([pa.array(m[keep]), pa.array(root[keep])], names=["u", "v"])

    out = written(points.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b").mapInArrow(join, "u long, v long"), "pairs")
    dropped(near)
    return out


def verify(sets: list[np.ndarray], n: np.ndarray, c: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that are similar, on the sets themselves."""
    i, j = pairs(n, c, side)
    if not len(i):
        return i, j
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    ok = np.zeros(len(i), bool)
    mark = np.zeros(len(names), np.int8)
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for lo, hi in zip(cuts, cuts[1:]):
        own = code[ends[i[lo]] : ends[i[lo] + 1]]
        mark[own] = 1
        for k in range(lo, hi):
            both = int(mark[code[ends[j[k]] : ends[j[k] + 1]]].sum(dtype=np.int64))
            ok[k] = 100 * both >= PERCENT * (n[i[k]] + n[j[k]] - both)
        mark[own] = 0
    return i[ok], j[ok]


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, key: str, text: str, tile: int) -> DataFrame:
    """(cid, other, similar): verified links, as weights of linked classes and edges that connect them."""
    members = groups.withColumnRenamed("v", "cid").join(classes.select("cid", "c1", "c2", "n", "size", "first"), "cid")
    totals = members.groupBy("root").agg(F.ceil(F.sum("n") / tile).cast("int").alias("t"))
    members = written(members.join(totals, "root").select("cid", "root", "t", "c1", "c2", "size", F.col("first").alias("k")), "members")
    small = members.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    cond = F.col("key").eqNullSafe(F.col("k"))
    found = texts.join(F.broadcast(members) if small else members, cond).select("text", "cid", "root", "t", "c1", "c2", "size")

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            h, at = _sets(b.column(0))
            keep, n, sets, counts = [], [], [], []
            c1, c2 = b.column(4).to_pylist(), b.column(5).to_pylist()
            for k in range(b.num_rows):
                u = np.unique(h[at[k] : at[k + 1]])
                if set_hash(u) == (c1[k], c2[k]):
                    keep.append(k)
                    n.append(len(u))
                    sets.append(u.tobytes())
                    counts.append(np.minimum(np.bincount((u & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS), _SATURATED).astype(np.uint16).tobytes())
            r = b.take(pa.array(keep, pa.int64()))
            return pa.RecordBatch.from_arrays([r.column(1), r.column(2), r.column(3), r.column(6), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], names=["cid", "root", "t", "size", "n", "set", "counts"])

        return one

    rows = W.per_text(found, ["text", "cid", "root", "t", "c1", "c2", "size"], make, "cid long, root long, t int, size long, n long, set binary, counts binary")
    rows = rows.withColumn("r", F.pmod(F.xxhash64("cid"), "t").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    rows = rows.select("root", F.least("r", "o").alias("a"), F.greatest("r", "o").alias("b"), "r", "cid", "size", "n", "set", "counts")

    def join(batches):
        for t in _grouped(batches, 3):
            cid, at = np.unique(np.asarray(t.column(4)), return_index=True)
            if len(cid) < 2:
                continue
            t2 = t.combine_chunks().take(pa.array(at))
            size, n = np.asarray(t2.column(5)), np.asarray(t2.column(6))
            sets = [np.frombuffer(x.as_buffer(), _U) for x in t2.column(7)]
            side = np.asarray(t2.column(3)) if t.column(1)[0] != t.column(2)[0] else None
            i, j = verify(sets, n, _counts(t2.column(8).combine_chunks()), side)
            if len(i):
                similar = np.zeros(len(cid), np.int64)
                np.add.at(similar, i, size[j])
                np.add.at(similar, j, size[i])
                m, root = forest(cid[i], cid[j])
                at = np.searchsorted(cid, m)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(root), pa.array(similar[at])], names=["cid", "other", "similar"])

    out = written(rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(join, "cid long, other long, similar long"), "links")
    dropped(members)
    return out


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", tile_points: int = TILE_POINTS, tile_shingles: int = TILE_SHINGLES, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Per document: key, n_shingles, n_similar (other documents linked directly), component_id (least key reachable).

    Null texts and texts without words are empty sets: linked with nothing, their component
    is their own key. A text of fewer than five words is one shingle. Equal sets are linked
    and counted without being compared; repeated rows count as documents of their own. A null
    key counts as a document, but a component is named by its least key that isn't null.
    An empty table gives an empty table; other columns aren't looked at; texts are whole.
    """
    spark = docs.sparkSession
    described = written(_describe(docs, key, text), "described")
    sets = described.where("n > 0").groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("keys").alias("keys"), F.count("*").alias("size"), F.min("key").alias("first"))
    classes = written(sets.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # the parts, of the size of the sets' tenth each, are not kept longer than needed
    wide, described = described, written(described.select("key", "c1", "c2", "n"), "ids")
    dropped(wide)
    swept(spark)
    candidates = _candidate_edges(classes, tile_points)
    wide, classes = classes, written(classes.drop("counts", "keys"), "names")
    dropped(wide)
    groups = written(components(candidates, driver_edges), "groups")
    swept(spark)
    links = _links(docs, classes, groups, key, text, tile_shingles)
    swept(spark)
    roots = components(links.select(F.col("cid").alias("u"), F.col("other").alias("v")), driver_edges).withColumnRenamed("v", "cid")
    linked = links.groupBy("cid").agg(F.sum("similar").alias("similar")).join(roots, "cid").join(classes.select("cid", "c1", "c2", "first"), "cid")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select("c1", "c2", "similar", "component")
    by_class = classes.select("c1", "c2", "size", "first").join(linked, ["c1", "c2"], "left")
    out = described.select("key", "c1", "c2", "n").join(by_class, ["c1", "c2"], "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, 0).otherwise(F.col("size") - 1 + F.coalesce("similar", F.lit(0))).cast("long").alias("n_similar"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("component", "first")).alias("component_id"),
    )
    out = written(out, "similar")
    for t in (described, classes, candidates, groups, links):
        dropped(t)
    swept(spark)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one of each group of similar ones: that of the smallest key; of rows that repeat key and text, one. Empty and null texts all stay."""
    out = similar(docs, key, text)
    go = written(out.where((F.col("n_shingles") > 0) & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_k"), F.lit(True).alias("_go")).distinct(), "go")
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = names[docs.columns.index(key)], names[docs.columns.index(text)]
    plain = docs.toDF(*names)
    small = go.count() <= 1 << 21  # 8 bytes each: at most 16 MB of keys
    stay = plain.join(F.broadcast(go) if small else go, F.col(k).eqNullSafe(F.col("_k")), "left_anti")
    return stay.toDF(*docs.columns)
