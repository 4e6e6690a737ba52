"""The registered queries over a whole small table, against other implementations."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

import __spark_entry__ as e
from corpusmill.llm import queries as q

SF = "/root/testdata/sf0.001"


def documents() -> list[dict]:
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_entry_has_rows(spark):
    assert e.entry(spark).count() == len(documents())


def test_op1_as_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in documents():
        ids = enc.encode_ordinary(d["text"] or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((d["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    got = [tuple(r) for r in e.queries()["op1_bpe"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_op10_covers_all_rows(spark):
    docs = documents()
    got = e.queries()["op10_shards"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs
    )
    n = len(docs)
    assert sorted(r.slot * 16 + r.shard for r in got) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op10_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(e.oracle_sql()["op10_shards"]).fetchall()
    assert sorted(want) == sorted(map(tuple, e.queries()["op10_shards"](spark, SF).collect()))
