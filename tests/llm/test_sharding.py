"""Walks of the permutation, by brute force over all numbers."""

import zlib

import duckdb
import numpy as np
import pytest

from corpusmill.llm import sharding as s

SEED = 20240601


def walked(n: int) -> tuple[np.ndarray, int]:
    """The place of each number below n, and the passes that the slowest needs."""
    a, b = s.sides(n)
    x, passes = np.arange(n), 0
    go = np.ones(n, bool)
    while go.any():
        x[go] = s.permute_once(x[go], a, b, s.keys(SEED))
        go, passes = x >= n, passes + 1
    return x, passes


@pytest.mark.parametrize("n", [1, 2, 7, 200, 1000, 4831, 4850, 4878, 25125, 116000])
def test_walk_length(n):
    places, passes = walked(n)
    assert s.walk_length(n, *s.sides(n), s.keys(SEED)) == max(passes, 1)
    assert np.array_equal(np.sort(places), np.arange(n))


@pytest.mark.parametrize("n", [0, 4850, 25125])
def test_shard_whole(spark, n):
    got = s.shard(spark.range(n), ["id"]).select("id", "shard", "slot").orderBy("id").collect()
    assert [r.slot * 16 + r.shard for r in got] == walked(n)[0].tolist()


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_sql_as_operator(spark):
    # rows that tie in key and size, an exact copy, beyond ASCII, empty and null
    rows = [(1, "ab"), (1, "ba"), (1, "ab"), (2, "é€😀"), (3, ""), (4, None), (None, "x")] + [(i, f"text {i}") for i in range(10, 203)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(s.assign_sql())
    assert [c[0] for c in found.description] == COLUMNS == s.assign(docs).columns
    want = found.fetchall()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(want, key=order) == sorted(map(tuple, s.assign(docs).collect()), key=order)
    assert sorted(r[2] for r in want) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
