"""Words around and beyond FOLD_BYTES: the fold, the heap and tiktoken."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from corpusmill.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def long_words() -> list[str]:
    draw = random.Random(0)
    out = []
    for size in (254, 255, 256, 257, 258, 300, 1000, 20000):
        out += ["a" * size, "=" * size, "".join(draw.choices("abcdeinorst", k=size)), "7" * size]
    return out + ["".join(draw.choices("的一是在不了有和人这", k=k)) for k in (85, 86, 2000)]


def encoder() -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_tiktoken(spark):
    texts = long_words()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.token_ids for r in bpe.encode(docs, RANKS).collect()}
    enc = encoder()
    assert [got[i] for i in range(len(texts))] == [enc.encode_ordinary(t) for t in texts]


def test_heap_as_fold(spark):
    words = [t for t in long_words() if len(t.encode()) <= 1000]
    ranks, lookup, enc = bpe.load_ranks(RANKS), bpe.rank_map(RANKS), encoder()
    ids = [[ranks[bytes([b])] for b in w.encode()] for w in words]
    fold = spark.createDataFrame([(ids,)], "words array<array<int>>").select(bpe.merge_column(bpe.F.col("words"), RANKS)).head()[0]
    heap = [bpe.heap_merge(x, lookup) for x in ids]
    assert fold == heap == [enc.encode_ordinary(w) for w in words]


def test_packed_ranks():
    base, owner, rank = bpe.rank_map(RANKS)
    both, bits = bpe.packed(owner, rank)
    assert both.dtype == np.int32 and bits == 16
    raw = both.view(np.uint32)
    taken = owner >= 0
    assert (raw[taken] >> bits == owner[taken]).all() and (raw[taken] & 0xFFFF == rank[taken]).all()
    assert (both[~taken] == -1).all() and max(owner.max(), rank.max()) < 0xFFFF
    wide, bits = bpe.packed(np.array([70_000, -1]), np.array([99_999, 0]))
    assert bits == 17 and wide.tolist() == [70_000 << 17 | 99_999, -1]


def test_plan_holds_no_table(spark):
    # as literals the ranks made 11 MB of text for each event of a query, and filled the driver
    docs = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    plan = bpe.digests(docs, RANKS)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000


def test_fold_keeps_one_array():
    # a step that cuts and joins the ids and the ranks in two arrays took 1.7 times the CPU
    column = str(bpe.fold_column(bpe.F.col("words"), bpe.codes(RANKS), bpe.F.col("base"), bpe.F.col("pairs")))
    assert column.count("concat(") == 1 and column.count("array_min(") == 2


def test_codes_in_every_width(spark):
    # the lookup with ids that need more bits than an int's half, and with room for no more than capped ranks
    ranks, lookup, enc = bpe.load_ranks(RANKS), bpe.rank_map(RANKS), encoder()
    words = [t for t in long_words() if len(t.encode()) <= 256] + [" Ezmenteí", "a", "aaaaab", "的一"]
    ids = [np.array([ranks[bytes([b])] for b in w.encode()], np.int32) for w in words]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    base, owner, rank = lookup
    spare = np.zeros(80_000, np.int32)
    for c in (bpe._Codes(lookup), bpe._Codes((np.append(base, spare), owner, rank)), bpe._Codes(lookup, 1 << 20)):
        at, flat = c.states(np.concatenate(ids), offs)
        states = [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        kind = "int" if c.table.dtype == np.int32 else "bigint"
        df = spark.createDataFrame([(states, c.base.tolist(), c.table.tolist())], f"words array<array<bigint>>, base array<int>, pairs array<{kind}>")
        got = df.select(bpe.fold_column(bpe.F.col("words"), c, bpe.F.col("base"), bpe.F.col("pairs"))).head()[0]
        end, out = c.ids(np.concatenate([np.array(x) for x in got]), np.concatenate([[0], np.cumsum([len(x) for x in got])]))
        assert [out[a:b].tolist() for a, b in zip(end, end[1:])] == [enc.encode_ordinary(w) for w in words]
