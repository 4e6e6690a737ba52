"""Connected components of an edge table, without one task for a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written

#: Edges (16 bytes each) that the driver may finish on; more are contracted by rounds first.
DRIVER_EDGES = 250_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every number in u or v, the root being the least of its component."""
    names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    up = np.arange(len(names))
    while True:  # hooking by minima and pointer jumping, both whole arrays at once
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return names, names[up]
        up = new


def _local(batches):
    """Per partition: its edges as edges from each member to its root."""
    u, v, size = [], [], 0
    for b in batches:
        u.append(np.asarray(b.column(0)))
        v.append(np.asarray(b.column(1)))
        size += b.num_rows
        if size > 1 << 20:  # bounded: contract what is held
            m, r = forest(np.concatenate(u), np.concatenate(v))
            keep = m != r
            u, v, size = [m[keep]], [r[keep]], 0
    if u:
        m, r = forest(np.concatenate(u), np.concatenate(v))
        keep = m != r
        yield pa.RecordBatch.from_arrays([pa.array(m[keep]), pa.array(r[keep])], names=["u", "v"])


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(v, root) of every number (long) in the edges (u, v); all of a component share one root."""
    spark = edges.sparkSession
    edges = written(edges.select("u", "v").where("u != v").mapInArrow(_local, "u long, v long"), "edges")
    maps: list[DataFrame] = []
    while (n := edges.count()) > driver_edges:
        # every vertex hooks to the neighbour of the least hash of this round, or to itself: a constant share of vertices goes
        seed = F.lit(len(maps))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("x"))
        hook = written(both.groupBy("u").agg(F.least(F.min(rank("v")), rank("u"))["x"].alias("to")), "hooks")
        maps.append(hook)
        a, b = hook.toDF("u", "ua"), hook.toDF("v", "vb")
        edges = written(edges.join(a, "u").join(b, "v").select(F.col("ua").alias("u"), F.col("vb").alias("v")).where("u != v").distinct().mapInArrow(_local, "u long, v long"), "edges")
    if n:
        t = edges.toPandas()
        m, r = forest(t.u.to_numpy(), t.v.to_numpy())
        pairs = spark.createDataFrame(pa.table({"v": m, "root": r}))
    else:
        pairs = spark.createDataFrame([], "v long, root long")
    for hook in reversed(maps):
        # what a vertex hooked to has a root by now, or is one
        pairs = hook.join(pairs.toDF("to", "root"), "to", "left").select(F.col("u").alias("v"), F.coalesce("root", "to").alias("root"))
        pairs = written(pairs, "roots")
    return pairs
