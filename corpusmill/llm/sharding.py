"""Reproducible shuffling into shards by a Feistel permutation of row numbers.

Rows get gapless numbers in key order (a range partitioning of narrow rows plus
partition offsets). A Feistel network over Z_a x Z_b, a * b >= N, permutes the
numbers; cycle walking brings places beyond N back. Place p goes to shard
p mod S, slot p div S, so counts differ by one at most and any row's shard and
slot can be computed from its number, the seed and N alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written

ROUNDS = 6
_P = 2147483647  # products of two numbers below it fit into 63 bits


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Round keys: a multiplier, an addend and a second multiplier each."""
    out, x = [], (seed * 2 + 1) % _P
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % _P
            row.append(x % (_P - 2) + 1)
        out.append(tuple(row))
    return out


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n, as near to n as a square allows."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, max(1, -(-n // a))


def _round(x, k):
    """A pseudo-random number below _P; works on ints, numpy arrays and Columns."""
    m, c, q = k
    y = (x * m + c) % _P
    return ((y * (y % 65521 + 1)) % _P * q + m) % _P


def permute_once(x, a: int, b: int, ks):
    """One pass of the network over numbers below a * b."""
    if isinstance(x, Column):
        return _permute_column(x, a, b, ks)
    left, right = x // b, x % b
    for i, k in enumerate(ks):
        if i % 2 == 0:
            left = (left + _round(right, k)) % a
        else:
            right = (right + _round(left, k)) % b
    return left * b + right


def _permute_column(x: Column, a: int, b: int, ks) -> Column:
    """The same as a fold over the rounds: unrolled, the expression would grow threefold with each."""
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(k, "mcq")], F.lit(i % 2 == 0).alias("even")) for i, k in enumerate(ks)])

    def step(s: Column, k: Column) -> Column:
        f = _round(F.when(k["even"], s["r"]).otherwise(s["l"]), (k["m"], k["c"], k["q"]))
        return F.struct(
            F.when(k["even"], (s["l"] + f) % a).otherwise(s["l"]).alias("l"),
            F.when(k["even"], s["r"]).otherwise((s["r"] + f) % b).alias("r"),
        )

    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def walk_length(n: int, a: int, b: int, ks) -> int:
    """The most passes that any number below n needs until it is below n again.

    Only the a * b - n < a places beyond n are followed, about sqrt(n) of them. Those
    that come back to their own start lie on cycles that no number below n enters.
    """
    if n <= 0:
        return 1
    start = out = np.arange(n, a * b, dtype=np.int64)
    passes = step = 1
    while len(out):
        out = permute_once(out, a, b, ks)
        step += 1
        if (out < n).any():
            passes = step
        stay = (out >= n) & (out != start)
        start, out = start[stay], out[stay]
    return passes


def place(number: Column, n: int, seed: int) -> Column:
    """The permuted place of a row number below n."""
    a, b = sides(n)
    ks = keys(seed)
    passes = F.sequence(F.lit(1), F.lit(walk_length(n, a, b, ks)))
    return F.aggregate(passes, number.cast("long"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(permute_once(x, a, b, ks)))


def number_rows(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """Add gapless numbers from 0 in the order of ``order``, without one global task; return the count too.

    Rows that tie in all of ``order`` get neighbouring numbers.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(f"`{c}`").asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in order])
    tagged = written(ranged.withColumn("_corpusmill_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_corpusmill_at", 33)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    base, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        base.append(total)
        total += counts.get(p, 0)
    # one offset a partition: bounded by spark.sql.shuffle.partitions
    offset = F.get(F.split(F.lit(",".join(map(str, base or [0]))), ",").cast("array<bigint>"), part.cast("int"))
    return tagged.withColumn(out, offset + F.col("_corpusmill_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_corpusmill_at"), total


def shard(df: DataFrame, order: list[str], shards: int = 16, seed: int = 20240601) -> DataFrame:
    """Add row_number, shard and slot. ``order`` must name the rows: ties in it are interchangeable.

    Law ``rows``: shard sizes differ by one at most and slots run from 0 without
    gaps. Null keys sort first; repeated rows are rows of their own; an empty table
    stays empty; texts aren't touched, so their length doesn't matter; columns of the
    names added are replaced.
    """
    df = df.drop("row_number", "shard", "slot")
    numbered, n = number_rows(df, order)
    p = place(F.col("row_number"), n, seed)
    placed = numbered.withColumn("_corpusmill_p", p)
    return placed.withColumn("shard", (F.col("_corpusmill_p") % shards).cast("int")).withColumn("slot", ((F.col("_corpusmill_p") - F.col("_corpusmill_p") % shards) / shards).cast("long")).drop("_corpusmill_p")


def assign(docs: DataFrame, shards: int = 16, seed: int = 20240601, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard documents: key, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Only the key, the size and two checksums of each text are moved. Equal texts are
    spread like any other rows: keeping them together can't go with equal counts.
    """
    t = F.col(f"`{text}`")
    narrow = docs.select(
        F.col(f"`{key}`"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    done = shard(narrow, [key, "size", "text_crc32"], shards, seed)
    return done.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql(text: str) -> str:
    """zlib's CRC-32 of a text's UTF-8 bytes as DuckDB SQL: a fold over the bytes with the usual table."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))"
    step = f"xor(list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1), c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {step}), 4294967295::BIGINT)"


def assign_sql(shards: int = 16, seed: int = 20240601) -> str:
    """The same as DuckDB SQL, all columns; a recursive query walks each row until it is below n."""
    ks = keys(seed)
    once = "SELECT id, n, a, b, pass, x // b AS l, x % b AS r FROM walk WHERE pass = 0 OR x >= n"
    for i, (m, c, q) in enumerate(ks):
        src, dst, mod = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        once = f"SELECT *, ({src} * {m} + {c}) % {_P} AS y FROM ({once})"
        once = f"SELECT * EXCLUDE (y) REPLACE (({dst} + ((y * (y % 65521 + 1)) % {_P} * {q} + {m}) % {_P}) % {mod} AS {dst}) FROM ({once})"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, {_crc32_sql("text")} AS text_crc32 FROM t),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id FROM d),
c AS (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS a FROM documents),
walk AS (
SELECT id, n, a, greatest(1, (n + a - 1) // a) AS b, 0 AS pass, id AS x FROM numbered, c
UNION ALL
SELECT id, n, a, b, pass + 1, l * b + r FROM ({once}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (id) WHERE pass > 0 AND x < n"""
